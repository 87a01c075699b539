"""An inverted index as a table of postings, and ranked search over it.

Postings are (doc, field, token, tf), lengths (doc, len). An index is built once and written, postings
sorted by token within files, lengths and if asked the rows themselves beside them; searches read it. A
file holds the postings that one task counted, of all words: dealt by word, one word of all rows would be
one task's. Rows of different keys are counted where they are read, in sorted runs. It is a version
of a store, marked by its source: a source that has changed gives the next version. A query's terms are
literals of the plan: they filter postings by prefix, which prunes row groups, and texts are not read or
cut into words again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import index_tokens, stems
from ..sources.scratch import folder
from ..sources.snapshots import Store, fingerprint

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """Postings and lengths as tables, the column of documents' keys, whether words are stemmed, and the
    documents themselves if they were written too. Where documents share texts, postings are of the
    texts: `texts` holds each once by the postings' key, with the number of its documents as copies."""

    postings: DataFrame
    lengths: DataFrame
    key: str
    stemmed: bool = False
    rows: DataFrame | None = None
    texts: DataFrame | None = None

    def matches(self, groups: list[list[str]], every: bool = True) -> DataFrame:
        return matches(self.postings, self.key, groups, every, self.stemmed)

    def tiers(self, groups: list[list[str]], **options) -> DataFrame:
        return bm25_tiers(self.postings, self.key, groups, stemmed=self.stemmed, sizes=self._sizes(), **options)

    def bm25(self, groups: list[list[str]], **options) -> DataFrame:
        return bm25(self.postings, self.key, groups, stemmed=self.stemmed, sizes=self._sizes(), **options)

    def _sizes(self) -> DataFrame:
        """(key, len), and copies where a text stands for several documents."""
        return self.lengths if self.texts is None else self.texts.where("len > 0").select(self.key, "len", "copies")


def postings(docs: DataFrame, key: str, fields: list[str], stemmed: bool = False) -> DataFrame:
    """(key, field, token, tf) of the fields' words, of any script, without their marks."""
    parts = [docs.select(F.col(key), F.lit(i).alias("at"), F.explode(index_tokens(F.coalesce(F.col(f), F.lit("")))).alias("token")) for i, f in enumerate(fields)]
    counted = reduce(DataFrame.unionByName, parts).groupBy(key, "at", "token").agg(F.count("*").alias("tf"))
    if stemmed:
        counted = counted.withColumn("token", stems("token")).groupBy(key, "at", "token").agg(F.sum("tf").alias("tf"))
    return counted.select(key, F.array(*map(F.lit, fields))[F.col("at")].alias("field"), "token", "tf")


#: Words that a task counts at once.
AT_ONCE = 1_000_000


def counted_in_place(docs: DataFrame, key: str, fields: list[str], stemmed: bool = False) -> DataFrame:
    """`postings` of rows whose keys differ, in runs sorted by token: a text's words are all in one row, so
    they are counted there, in Arrow batches, and nothing is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(fields):
                words = batch.column(i + 1)
                sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                stops, at = np.cumsum(sizes), 0
                while at < len(stops):
                    end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + AT_ONCE, "right")))
                    found = words.slice(at, end - at).flatten().dictionary_encode()
                    names = found.dictionary
                    if stemmed:
                        names = pa.array([stem(w) for w in names.to_pylist()], pa.string())
                    names = names.dictionary_encode()
                    order = pc.sort_indices(names.dictionary)
                    place = np.empty(len(order), np.int64)
                    place[order.to_numpy()] = np.arange(len(order))
                    code = place[names.indices.to_numpy()][found.indices.to_numpy()]
                    each, tf = np.unique(code * (end - at) + np.repeat(np.arange(end - at), sizes[at:end]), return_counts=True)
                    rows, token = each % (end - at), names.dictionary.take(order).take(pa.array(each // (end - at)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at).take(pa.array(rows)), pa.array([name] * len(rows), pa.string()), token, pa.array(tf, pa.int64())], names=["key", "field", "token", "tf"])
                    at = end

    texts = docs.select(F.col(key).alias("key"), *[index_tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    out = texts.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, field string, token string, tf long")
    return out.select(F.col("key").alias(key), "field", "token", "tf")


def write_index(docs: DataFrame, key: str, fields: list[str], path: str, stemmed: bool = True, rows: bool = False, mark: str | None = None) -> Index:
    """The next version of the index at a path: postings sorted by token within files, lengths, and the
    documents if `rows`. Readers of an earlier version keep it; a write that fails leaves none."""
    store = Store(docs.sparkSession, path)
    store.commit(_tables(docs, key, fields, stemmed, rows), mark)
    return read_index(docs.sparkSession, key, path, stemmed)


def _tables(docs: DataFrame, key: str, fields: list[str], stemmed: bool, rows: bool) -> dict:
    out = {"rows": docs} if rows else {}

    def posts(done: dict) -> DataFrame:
        texts = done.get("rows", docs)
        if texts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return counted_in_place(texts, key, fields, stemmed)
        # Rows that share a key are one document: its words are brought together.
        return postings(texts, key, fields, stemmed).sortWithinPartitions("token", key)

    out["postings"] = posts
    out["lengths"] = lambda done: lengths(done["postings"], key)
    return out


def read_index(spark: SparkSession, key: str, path: str, stemmed: bool = True) -> Index:
    store = Store(spark, path)
    last = store.manifest()
    if last is None:
        raise KeyError(f"no index at {path}")
    tables = {n: store.read(n, last["version"]) for n in last["tables"]}
    return Index(tables["postings"], tables["lengths"], key, stemmed, tables.get("rows"))


_STORES: dict[tuple, str] = {}


def index_of(docs: DataFrame, key: str, fields: list[str], name: str, stemmed: bool = False, rows: bool = False) -> Index:
    """The index of a table that `name` tells apart: written by the first call of the session, read by
    later ones, and written anew as the next version once the table's files or its plan have changed. A
    table that reads no files cannot be told to be unchanged: its index is not written."""
    tables = stored_tables(docs, lambda: _tables(docs, key, fields, stemmed, rows), name, key, tuple(fields), stemmed, rows)
    if not tables:
        posts = postings(docs, key, fields, stemmed)
        return Index(posts, lengths(posts, key), key, stemmed, docs if rows else None)
    return Index(tables["postings"], tables["lengths"], key, stemmed, tables.get("rows"))


def stored_tables(docs: DataFrame, build: Callable[[], dict], *known) -> dict[str, DataFrame]:
    """The last version of the tables that `known` tells apart, made by `build` where the files or the plan
    of `docs` have changed; none where it reads no files."""
    spark = docs.sparkSession
    mark = fingerprint(docs)
    if mark is None:
        return {}
    store = Store(spark, _STORES.setdefault((spark.sparkContext.applicationId, *known), folder(spark, "index")))
    store.refreshed(mark, build)
    last = store.manifest()
    return {n: store.read(n, last["version"]) for n in last["tables"]}


def lengths(posts: DataFrame, key: str) -> DataFrame:
    return posts.groupBy(key).agg(F.sum("tf").alias("len"))


def _quoted(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _weight(weights: dict[str, float] | None) -> str:
    """A posting's weight by its field, as SQL; fields without one weigh nothing."""
    if not weights:
        return "tf"
    return f"tf * CASE field {' '.join(f'WHEN {_quoted(f)} THEN {float(w)}D' for f, w in weights.items())} ELSE 0D END"


def _hits(posts: DataFrame, key: str, terms: list[str], weights: dict[str, float] | None, stemmed: bool) -> DataFrame:
    """(key, weighted hits f and hits n by term): one pass over postings that any term is a prefix of."""
    is_hit = [f"startswith(token, {_quoted(stem(x) if stemmed else x)})" for x in terms]
    sums = [x for i, h in enumerate(is_hit) for x in (f"sum(CASE WHEN {h} THEN double({_weight(weights)}) ELSE 0D END) AS f{i}", f"sum(CASE WHEN {h} THEN tf ELSE 0 END) AS n{i}")]
    return posts.where(" OR ".join(is_hit)).groupBy(key).agg(*map(F.expr, sums))


def matches(posts: DataFrame, key: str, groups: list[list[str]], every: bool = True, stemmed: bool = False) -> DataFrame:
    """Keys that hold a prefix match of every group, or of any."""
    hits = _hits(posts, key, [t for g in groups for t in g], None, stemmed)
    return hits.where(_met(groups, every)).select(key)


def _met(groups: list[list[str]], every: bool) -> str:
    """Whether a row holds a prefix match of every group, or of any, as SQL."""
    at, conds = 0, []
    for g in groups:
        conds.append("(" + " OR ".join(f"n{at + i} > 0" for i in range(len(g))) + ")")
        at += len(g)
    return "(" + (" AND " if every else " OR ").join(conds) + ")" if conds else "false"


def _scored(hits: DataFrame, key: str, sizes: DataFrame, terms: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """The hits' rows with each term's part of their score, by name from its columns of weighted hits
    and of hits. A row of `sizes` counts as many documents as its copies, if it has them. What holds for all rows (the number of rows, their mean length, how rare a term is) is
    one row, worked out once."""
    if "copies" in sizes.columns:
        totals = sizes.agg(F.sum("copies").alias("docs"), (F.sum(F.expr("len * copies")) / F.sum("copies")).alias("avgdl"))
        seen = hits.join(sizes.select(key, "copies"), key).agg(*[F.expr(f"coalesce(sum(CASE WHEN {n} > 0 THEN copies END), 0L) AS d_{name}") for name, (_, n) in terms.items()])
    else:
        totals = sizes.agg(F.count("*").alias("docs"), F.avg("len").alias("avgdl"))
        seen = hits.agg(*[F.expr(f"count_if({n} > 0) AS d_{name}") for name, (_, n) in terms.items()])
    rare = [f"greatest(ln((docs - d_{x} + 0.5D) / (d_{x} + 0.5D)), 1e-6D) AS idf_{x}" for x in terms]
    once = totals.crossJoin(F.broadcast(seen)).selectExpr("avgdl", *rare)
    leaf = lambda x, f: f"-idf_{x} * {f} * {K1 + 1}D / ({f} + {K1}D * ({1 - B}D + {B}D * len / avgdl)) AS {x}"
    return hits.join(sizes, key).crossJoin(F.broadcast(once)).selectExpr(f"`{key}`", *keep, *[leaf(x, f) for x, (f, _) in terms.items()])


def bm25(posts: DataFrame, key: str, groups: list[list[str]], every: bool = False, compound: list[str] = (), weights: dict[str, float] | None = None, fields: list[str] | None = None, stemmed: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(key, score) of the matching keys; more negative is better.

    A term counts in a row only if the branch it is in matches the row: all groups together when
    `every`, and each compound by itself. `fields` limits hits and document counts, not lengths.
    """
    both = bm25_tiers(posts, key, groups, compound, weights, fields, stemmed, sizes)
    score = F.col("strict" if every else "loose")
    return both.where(score.isNotNull()).select(key, score.alias("score"))


def bm25_tiers(posts: DataFrame, key: str, groups: list[list[str]], compound: list[str] = (), weights: dict[str, float] | None = None, fields: list[str] | None = None, stemmed: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(key, strict, loose): the scores of `bm25` for all groups and for any, null where a row does not
    match so; one pass for a search that tries the first before the second."""
    terms, n = [t for g in groups for t in g] + list(compound), sum(map(len, groups))
    hits = _hits(posts.where(F.col("field").isin(*fields)) if fields else posts, key, terms, weights, stemmed)
    alone = " OR ".join(f"n{i} > 0" for i in range(n, len(terms))) or "false"
    keep = [f"{_met(groups, True)} AS _all", f"{_met(groups, False)} AS _any", f"({alone}) AS _alone"]
    rows = _scored(hits, key, lengths(posts, key) if sizes is None else sizes, {f"l{i}": (f"f{i}", f"n{i}") for i in range(len(terms))}, keep)
    own, joined = (" + ".join(f"l{i}" for i in r) or "0D" for r in (range(n), range(n, len(terms))))
    score = lambda met, name: f"CASE WHEN {met} OR _alone THEN CASE WHEN {met} THEN {own} ELSE 0D END + {joined} END AS {name}"
    return rows.where("_all OR _any OR _alone").selectExpr(f"`{key}`", score("_all", "strict"), score("_any", "loose"))


def field_tiers(index: Index, terms: list[str], main: list[str], weights: dict[str, float], k: int) -> DataFrame:
    """(key, tier, score) of the k best of a search in three tiers over one reading of the postings: 0,
    all terms in the main fields; 1, any of them there; 2, any in any field. Scores are weighted BM25,
    within the main fields for the first two tiers, where other fields' hits and document counts do not
    count; the tier comes first, then the score (six places), then the key."""
    inside, weight = f"field IN ({', '.join(map(_quoted, main))})", _weight(weights)
    hit = [f"startswith(token, {_quoted(stem(x) if index.stemmed else x)})" for x in terms]
    count = lambda c, by, name: f"sum(CASE WHEN {c} THEN double({by}) ELSE 0D END) AS {name}"
    sums = [x for i, h in enumerate(hit) for x in (count(f"{h} AND {inside}", weight, f"mf{i}"), count(f"{h} AND {inside}", "tf", f"mn{i}"), count(h, weight, f"f{i}"), count(h, "tf", f"n{i}"))]
    hits = index.postings.where(" OR ".join(hit)).groupBy(index.key).agg(*map(F.expr, sums))
    held = [f"mn{i} > 0" for i in range(len(terms))]
    tier = f"CASE WHEN {' AND '.join(held)} THEN 0 WHEN {' OR '.join(held)} THEN 1 ELSE 2 END AS tier"
    parts = {f"{m}l{i}": (f"{m}f{i}", f"{m}n{i}") for i in range(len(terms)) for m in ("m", "")}
    rows = _scored(hits, index.key, index.lengths, parts, [tier])
    total = lambda m: " + ".join(f"{m}l{i}" for i in range(len(terms)))
    scored = rows.selectExpr(f"`{index.key}`", "tier", f"round(CASE WHEN tier < 2 THEN {total('m')} ELSE {total('')} END, 6) AS score")
    return scored.orderBy("tier", "score", index.key).limit(k)
