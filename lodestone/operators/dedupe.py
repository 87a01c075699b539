"""Greedy near-duplicate removal of short labels within an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import stored


def near_pairs(labels: DataFrame, share: float = 0.8) -> DataFrame:
    """(owner, a, b) of labels (owner, label, ts) whose token sets are equal, or both of three or more
    with `share` of the smaller in the other; a comes before b by length, then letters.

    The smaller set of m tokens has one of any m - ceil(share m) + 1 of its tokens in the other, so
    pairs meet on its rarest tokens only. Labels without a token are like one another."""
    sized = labels.withColumn("m", F.size("ts"))
    held = sized.select("owner", "label", "m", F.explode("ts").alias("t"))
    often = held.groupBy("owner", "t").agg(F.count("*").alias("often"))
    ranked = held.join(often, ["owner", "t"]).groupBy("owner", "label", "m").agg(F.sort_array(F.collect_list(F.struct("often", "t"))).alias("by"))
    probes = F.col("m") - F.ceil(F.col("m") * F.lit(share) - 1e-9).cast("int") + 1
    rare = ranked.select("owner", F.col("label").alias("x"), F.explode(F.slice(F.col("by.t"), F.lit(1), probes)).alias("t"), F.col("m").alias("mx"))
    met = rare.join(held.select("owner", F.col("label").alias("y"), "t", F.col("m").alias("my")), ["owner", "t"]).where("x <> y and mx <= my").select("owner", "x", "y").distinct()
    both = met.join(sized.select("owner", F.col("label").alias("x"), F.col("ts").alias("tx")), ["owner", "x"]).join(sized.select("owner", F.col("label").alias("y"), F.col("ts").alias("ty")), ["owner", "y"])
    same = F.size(F.array_intersect("tx", "ty"))
    less = F.least(F.size("tx"), F.size("ty"))
    near = ((same == F.size("tx")) & (same == F.size("ty"))) | ((less >= 3) & (same >= F.lit(share) * less - 1e-9))
    first = F.struct(F.length("x"), "x") < F.struct(F.length("y"), "y")
    pairs = both.where(near).select("owner", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    bare = labels.where(F.size("ts") == 0)
    lead = bare.groupBy("owner").agg(F.min_by("label", F.struct(F.length("label"), "label")).alias("a"))
    return pairs.union(bare.join(lead, "owner").where("label <> a").select("owner", "a", F.col("label").alias("b"))).distinct()


def greedy_near_duplicates(rows: DataFrame, owner: str, label: str, share: float = 0.8) -> DataFrame:
    """(owner, label): shortest labels first, each kept unless it is like one kept (see `near_pairs`).

    In rounds of joins: a label without an undecided or kept one before it is kept, one that is like a
    kept one goes. The first undecided label is always decided, and most are in a round or two. No
    owner's labels come together in one task. Null labels are left out."""
    labels = rows.select(F.col(owner).alias("owner"), F.col(label).alias("label")).where("owner is not null and label is not null").distinct()
    labels = stored(labels.withColumn("ts", F.array_distinct(tokens(F.col("label")))), "labels")
    pairs = stored(near_pairs(labels, share), "pairs")
    kept = labels.select("owner", "label").join(pairs.select("owner", F.col("b").alias("label")), ["owner", "label"], "left_anti")
    kept, gone = stored(kept, "kept"), None
    while True:
        new = pairs.join(kept.select("owner", F.col("label").alias("a")), ["owner", "a"], "left_semi").select("owner", F.col("b").alias("label")).distinct()
        gone = stored(new if gone is None else gone.union(new).distinct(), "gone")
        # Pairs whose first label goes decide nothing; those whose second goes are decided.
        pairs = stored(pairs.join(gone.select("owner", F.col("label").alias("a")), ["owner", "a"], "left_anti").join(gone.select("owner", F.col("label").alias("b")), ["owner", "b"], "left_anti"), "pairs")
        left = labels.select("owner", "label").join(gone, ["owner", "label"], "left_anti").join(kept, ["owner", "label"], "left_anti")
        more = stored(left.join(pairs.select("owner", F.col("b").alias("label")), ["owner", "label"], "left_anti"), "more")
        if more.isEmpty():
            return kept.select(F.col("owner").alias(owner), F.col("label").alias(label))
        kept = stored(kept.union(more), "kept")
