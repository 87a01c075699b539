"""Triple patterns over a table of (s, p, o): each pattern is a filter, shared variables are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..sources.snapshots import Store, fingerprint

_STORES: dict[tuple, str] = {}


def store_of(triples: DataFrame, name: str) -> DataFrame:
    """The triples as a stored table with a folder for each predicate, subjects in order within: a
    pattern reads its own predicates' folders and no others. Written by the first call of the session for
    what `name` tells apart, again when the files behind the triples change, and read otherwise; triples
    that read no files are given back as they are."""
    spark, mark = triples.sparkSession, fingerprint(triples)
    if mark is None:
        return triples
    path = _STORES.setdefault((spark.sparkContext.applicationId, name), folder(spark, "triples"))
    store = Store(spark, path)
    store.refreshed(mark, lambda: {"triples": triples.select("s", "p", "o").repartitionByRange("p", "s").sortWithinPartitions("p", "s")}, by="p")
    return store.read("triples")


def pattern(triples: DataFrame, s: str, p: str | list[str], o: str) -> DataFrame:
    """The bindings of one pattern. '?x' is a variable; several predicates are alternatives."""
    t = triples.where(F.col("p").isin(*p) if isinstance(p, list) else F.col("p") == p)
    out = []
    for column, term in (("s", s), ("o", o)):
        if term.startswith("?"):
            out.append(F.col(column).alias(term[1:]))
        else:
            t = t.where(F.col(column) == term)
    return t.select(*out) if out else t.select(F.lit(True).alias("_"))


def match(triples: DataFrame, patterns: list[tuple]) -> DataFrame:
    """Basic graph pattern: patterns joined on the variables that they share with those before."""
    rows = pattern(triples, *patterns[0])
    for p in patterns[1:]:
        more = pattern(triples, *p)
        shared = [c for c in more.columns if c in rows.columns]
        if not shared:
            raise ValueError("a pattern must share a variable with those before it")
        rows = rows.join(more, shared)
    return rows


def optional(rows: DataFrame, triples: DataFrame, p: tuple) -> DataFrame:
    more = pattern(triples, *p)
    return rows.join(more, [c for c in more.columns if c in rows.columns], "left")


def tail(iri):
    return F.element_at(F.split(iri, "[/#]"), -1)
