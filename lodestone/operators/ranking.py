"""Orders, pages, tiers and pinned rows. Every limit has a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page with the total of rows and those after the page."""
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset(offset).limit(size)
    # The total is one row.
    return shown.crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.lit(offset + size)))


def tiered(tiers: list[DataFrame], key: str, order: list[str], k: int) -> DataFrame:
    """Rows of the first tier that has their key, tiers in turn, until k are had."""
    marked = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    both = reduce(DataFrame.unionByName, marked)
    rest = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.min(F.struct("tier", *order, *[c for c in rest if c not in ("tier", *order)])).alias("b"))
    return best.select(key, "b.*").orderBy("tier", *order, key).limit(k)


def cascade(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """The rows of the least tier that has any, as one plan: the least tier is one broadcast row."""
    least = rows.agg(F.min(tier).alias("_least"))
    return rows.join(F.broadcast(least), F.col(tier) == F.col("_least")).drop("_least")


def distinct_by(rows: DataFrame, norm: Column, order: list[str]) -> DataFrame:
    """The first row of each normal form."""
    rest = rows.columns
    return rows.groupBy(norm.alias("_n")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("r.*")


def top_in_groups(rows: DataFrame, keys: list[str], item: Column, k: int) -> DataFrame:
    """Per group the least k items (structs order by their fields) and the number of all.

    Ranked before the groups are gathered, so no array is longer than k."""
    w = Window.partitionBy(*keys).orderBy("_item")
    ranked = rows.select(*keys, item.alias("_item")).withColumn("_r", F.row_number().over(w))
    first = ranked.where(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_item")).alias("first"))
    return first.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def pinned(rows: DataFrame, keys: list[str], required: str, score: str, position: str, k: int) -> DataFrame:
    """Per group the required rows, then the best others, k at most."""
    w = Window.partitionBy(*keys).orderBy(F.col(required).desc(), F.col(score).desc(), position)
    return rows.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k)


def grouped_with_rest(rows: DataFrame, group: str, order: list[str], item: Column, keys: list[str] = ()) -> DataFrame:
    """Items by group in order, groups in the order of their first item, and those without a group (null
    or empty) each by itself after all groups: position (from 1), group, items. By `keys` if given."""
    whole = F.nullif(F.trim(F.col(group)), F.lit(""))
    alone = F.when(whole.isNull(), F.struct(*order))
    gathered = rows.groupBy(*keys, whole.alias("_group"), alone.alias("_alone")).agg(F.min(F.struct(*order)).alias("_first"), F.sort_array(F.collect_list(F.struct(*order, item.alias("_item")))).alias("_items"))
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_group").isNull(), "_first"))
    return gathered.select(*keys, place.alias("position"), F.col("_group").alias(group), F.transform("_items", lambda x: x["_item"]).alias("items"))
