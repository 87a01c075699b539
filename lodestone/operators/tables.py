"""Table maintenance: upserts, overrides, incremental targets, cache expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _picked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key by an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def row_hash(rows: DataFrame) -> Column:
    """A hash of whole rows, maps aside, null told from empty: it settles what an order leaves open."""
    return F.xxhash64(*[x for c, kind in rows.dtypes if "map<" not in kind for x in (F.col(c).isNull(), F.col(c))])


def last_wins(rows: DataFrame, keys: list[str], seq: str, then: list[str] | None = None) -> DataFrame:
    """Upsert by replacement: of each key the row of the greatest sequence, of any type that has an
    order. A row without a sequence wins only where its key has no other. Of equal sequences the row
    that is greatest in `then` wins, and last that of the greatest hash, so the result is defined."""
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(seq).isNotNull().alias("known"), F.col(seq).alias("o"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(then or [])], row_hash(rows).alias("h")]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row of the least sequence; a row without one wins only where there is no other."""
    return _picked(rows, keys, [F.col(seq).isNull().alias("none"), F.col(seq).alias("o")])


def override(base: DataFrame, layer: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The base's columns, with the layer's value wherever it has one."""
    top = layer.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(top, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def pending(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets whose key has not been done."""
    return targets.join(done.select(*keys), keys, "left_anti")


def changed(targets: DataFrame, done: DataFrame, key: str, value: str) -> DataFrame:
    """Targets never done, or done under another value (null being a value)."""
    before = done.select(key, F.col(value).alias("_before"), F.lit(True).alias("_seen"))
    joined = targets.join(before, key, "left")
    return joined.where(F.col("_seen").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_seen")


def unexpired(cache: DataFrame, now: Column, ttl_seconds: int, created: str = "created_at") -> DataFrame:
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp(created) <= ttl_seconds)


def most_recent(cache: DataFrame, keep: int, accessed: str = "accessed_at", key: str = "cache_key") -> DataFrame:
    """The most recently used entries: a top-k, with the key to settle ties."""
    return cache.orderBy(F.col(accessed).desc(), key).limit(keep)


def touched(cache: DataFrame, log: DataFrame, key: str = "cache_key", at: str = "ts") -> DataFrame:
    """Access times brought up to date from an append-only log of reads."""
    last = log.groupBy(key).agg(F.max(at).alias("_last"))
    return cache.join(last, key, "left").withColumn("accessed_at", F.greatest("accessed_at", "_last")).drop("_last")


def fresh_or_stale(keys: DataFrame, fetched: DataFrame, key: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Each key with its payload and whether that is fresh; a stale one serves where nothing better is."""
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    return keys.join(fetched, key, "left").withColumn("state", F.when(F.col("fetched_at").isNull(), "missing").when(age <= ttl_seconds, "fresh").otherwise("stale"))
