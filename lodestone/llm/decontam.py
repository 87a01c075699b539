"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words at a mask's positions; the other positions of its span may differ.
Seeds of the documents are joined with those of the benchmark. Each hit is then verified along its
diagonal (document position less item position): some window there must agree in enough words, so
substituted words between hits are tolerated.

The text is shuffled nowhere. Documents are walked in place; the benchmark's seeds are broadcast up
to `MOST_SEEDS` (24 bytes each), and beyond that joined by a shuffle of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh, words, written

#: Above so many seeds the join shuffles.
MOST_SEEDS = 4_000_000
#: 1 is a position that must agree. Each mask has weight six.
MASKS = ("1110111", "11011011", "1100101011")


@dataclass(frozen=True)
class Limits:
    window: int = 13  # words; shorter items are one window
    agree: int = 80  # hundredths of a window's words


def normal_words(text: Column) -> Column:
    """Hashes of a text's words, lower case and without ASCII punctuation."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\p{Punct}+", "")
    return F.transform(words(plain), lambda w: F.xxhash64(w))


def _masks() -> Column:
    return F.array(*[F.array(*[F.lit(i) for i, x in enumerate(m) if x == "1"]) for m in MASKS])


def _seeds_at(h: Column, at: Column) -> Column:
    """The seed of each mask laid at a place. Past the end it lacks words, and the check will tell."""
    return F.transform(_masks(), lambda m: F.xxhash64(m, F.transform(m, lambda o: F.get(h, at + o))))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(bkey, item_at, item_words, pair, seed) of the benchmark: masks that lie within the item."""
    spans = F.array(*[F.lit(len(m)) for m in MASKS])
    laid = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("b") - min(map(len, MASKS)), F.lit(0)))))
    fit = F.filter(_seeds_at(F.col("b"), F.col("item_at")), lambda s, k: F.col("item_at") + F.get(spans, k) <= F.size("b"))
    return laid.select("bkey", "item_at", F.size("b").alias("item_words"), F.xxhash64(F.get("b", F.col("item_at")), F.get("b", F.col("item_at") + 1)).alias("pair"), F.explode(fit).alias("seed"))


def _around(hits: DataFrame, before: Column, after: Column, *more: str) -> DataFrame:
    """Each hit with the words from `before` places ahead of it to `after` behind, in place of all the text's."""
    low = F.greatest(F.col("at") - before, F.lit(0))
    return hits.select("doc_id", "at", low.alias("low"), F.slice("h", low + 1, F.col("at") - low + after + max(map(len, MASKS))).alias("h"), *more)


def _window(item: Column, limits: Limits) -> Column:
    return F.least(F.size(item), F.lit(limits.window))


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limits: Limits = Limits(), most_seeds: int = MOST_SEEDS) -> DataFrame:
    """One row per document id and benchmark item that overlap: the best aligned stretch.

    doc_id, item_id, doc_at (first aligned word), aligned (words of item and document side by side),
    matched (equal ones), best (most equal words in a window), diagonals. Items of equal words count
    as one under their least id. Items and texts of under seven words have no seed and so no row;
    null texts count as empty. Rows that share a document id are reported together; a null id is an
    id like others. Ties take the least document position. Empty tables give an empty result.
    """
    d = docs.select(F.col(f"`{id}`").alias("doc_id"), normal_words(F.col(f"`{text}`")).alias("h"))
    items = (
        benchmark.select(F.col(f"`{item}`").alias("item_id"), normal_words(F.col(f"`{item_text}`")).alias("b"))
        .groupBy("b")
        .agg(F.min("item_id").alias("item_id"))
        # Shorter items have no seed. Of the others a word has two seeds or more on average, nearly
        # all places having one a mask, so a bound on seeds is one on the items' words.
        .where(F.size("b") >= min(map(len, MASKS)))
        .select(F.xxhash64("b").alias("bkey"), "item_id", "b")
    )
    items = written(items, "items")
    seeds = _item_seeds(items)
    places = F.sequence(F.lit(0), F.size("h") - min(map(len, MASKS)))
    # An outer explode: an inner one would have Spark work the words out twice, for an inferred filter.
    laid = F.explode_outer(F.when(F.size("h") >= min(map(len, MASKS)), places)).alias("at")
    if fits(seeds, most_seeds):
        # All masks begin with two words that count: most places end with that test.
        # A place takes along the words that an item with its pair can reach.
        pairs = F.broadcast(seeds.groupBy("pair").agg(F.max("item_at").alias("before"), F.max(F.col("item_words") - F.col("item_at")).alias("after")))
        pair = F.xxhash64(F.get("h", F.col("at")), F.get("h", F.col("at") + 1))
        near = d.select("doc_id", "h", laid).where("at is not null").join(pairs, pair == F.col("pair"))
        near = _around(near, F.col("before"), F.col("after"))
        near = near.withColumn("seed", F.explode(_seeds_at(F.col("h"), F.col("at") - F.col("low"))))
        hits = near.join(F.broadcast(seeds.drop("pair", "item_words")), "seed").join(F.broadcast(items), "bkey")
    else:
        keyed = d.select("doc_id", F.posexplode_outer(F.when(F.size("h") >= min(map(len, MASKS)), F.transform(places, lambda i: _seeds_at(F.col("h"), i)))).alias("at", "all"))
        found = keyed.select(F.col("doc_id").alias("hit_id"), "at", F.explode("all").alias("seed")).join(seeds.drop("pair"), "seed").drop("seed").distinct()
        # Each hit takes along the words that its own item can reach.
        near = _around(found.join(d, F.col("hit_id").eqNullSafe(F.col("doc_id"))), F.col("item_at"), F.col("item_words") - F.col("item_at"), "bkey", "item_at")
        hits = near.join(items, "bkey")
    start = F.greatest(F.col("diagonal"), F.lit(0))
    length = F.least(F.size("h") + F.col("low") - start, F.size("b") - (start - F.col("diagonal")))
    equal = F.zip_with(F.slice("h", start - F.col("low") + 1, length), F.slice("b", start - F.col("diagonal") + 1, length), lambda x, y: (x == y).cast("int"))
    w = _window(F.col("b"), limits)
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - w + 1), lambda i: F.aggregate(F.slice(F.col("equal"), i, w), F.lit(0), lambda a, x: a + x))
    # A hit is left to the one before it on its diagonal where the words before both agree as well.
    span = min(map(len, MASKS))
    before = [F.coalesce(F.get("h", F.col("at") - F.col("low") + j) == F.get("b", F.col("item_at") + j), F.lit(False)) for j in range(-1, span)]
    runs_on = before[0]
    for x in before[1:]:
        runs_on = runs_on & x
    return (
        hits.where(~runs_on)
        .withColumn("diagonal", F.col("at") - F.col("item_at"))
        .withColumn("doc_at", start)
        .withColumn("equal", equal)
        .where(F.size("equal") >= w)
        .withColumn("best", F.array_max(sums))
        .where(100 * F.col("best") >= limits.agree * w)
        .select("doc_id", "item_id", "doc_at", "diagonal", F.size("equal").alias("aligned"), F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("matched"), "best")
        .groupBy("doc_id", "item_id")
        .agg(
            F.max(F.struct("best", "matched", (-F.col("doc_at")).alias("first"), "aligned")).alias("top"),
            F.count_distinct("diagonal").alias("diagonals"),
        )
        .select("doc_id", "item_id", (-F.col("top.first")).alias("doc_at"), "top.aligned", "top.matched", "top.best", "diagonals")
    )


def without(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, in their own columns, that overlap with no benchmark item. Each row goes or stays by
    its own text: rows that share an id with a leaking one, or have none like it, are not drawn along."""
    own, leaked = fresh(docs, "own_key", "leaked_key")
    key = F.xxhash64(F.col(f"`{id}`").isNull(), F.col(f"`{id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    keyed = docs.withColumn(own, key)
    bad = overlaps(keyed, benchmark, id=own, text=text, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return keyed.join(bad, F.col(own) == F.col(leaked), "left_anti").drop(own)
