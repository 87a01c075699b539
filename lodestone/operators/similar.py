"""Nearest vectors of many queries at once: products of matrices in Arrow batches, bounded lists merged.

A task multiplies its rows, a batch at a time, by the queries' matrix and keeps the k best of each query
seen so far: a bounded heap as a matrix. What tasks keep, k rows a query, is merged by one ranking at
the end. The queries travel to the tasks in blocks of a fixed size, so a long table of queries makes
more passes and not a larger broadcast; no row of the searched table is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block's matrix: 8 MB of doubles travel with a pass. Queries and rows whose scores are held
#: at once: 8 MB.
BLOCK, ASKED, ROWS = 1 << 20, 512, 2048


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(1, keepdims=True))
    norms[norms == 0] = 1
    return m / norms


def topk_batch(rows: DataFrame, queries: DataFrame, k: int, least: float, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", same: bool = False) -> DataFrame:
    """(query_key, key, score, rank): for each query the k rows most like it, by cosine to six places and
    then by key, that reach `least`. Keys are whole numbers. Vectors that are null, of no length, or of
    another number of dimensions than the queries' first are like nothing. `same` takes a row whose key is the query's, which is
    left out otherwise. Queries (query_key, embedding) are read in blocks; each is one pass over rows."""
    asked = queries.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(query_key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    shape = asked.agg(F.count("*"), F.min_by(F.size("v"), "q")).first()
    count, width = shape[0], shape[1] or 1
    blocks = max(1, -(-count * width // BLOCK))
    found = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == width)
    passes = []
    for b in range(blocks):
        block = asked.where((F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) & (F.size("v") == width)).orderBy("q").toArrow()
        ids = block["q"].to_numpy()
        matrix = _unit(block["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)) if len(ids) else np.zeros((0, width))
        passes.append(found.mapInArrow(lambda batches, ids=ids, matrix=matrix: _pass(batches, ids, matrix, k, least, same), "q bigint, key bigint, score double"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    kept = reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return kept.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def _pass(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, least: float, same: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query of a block."""
    width = matrix.shape[1]
    scores, keys = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            few = batch.slice(start, ROWS)
            flat = few["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            own = few["key"].to_numpy(zero_copy_only=False)
            sound = np.isfinite(flat).all(1) & (flat != 0).any(1)
            unit, own = _unit(flat[sound]).T, own[sound].astype(np.int64)
            for at in range(0, len(ids) if len(own) else 0, ASKED):
                _keep(scores[at : at + ASKED], keys[at : at + ASKED], ids[at : at + ASKED], np.round(matrix[at : at + ASKED] @ unit, 6), own, least, same)
    q, i = np.nonzero(scores > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[q, i]), pa.array(scores[q, i])], ["q", "key", "score"])


def _keep(scores: np.ndarray, keys: np.ndarray, ids: np.ndarray, got: np.ndarray, own: np.ndarray, least: float, same: bool) -> None:
    """Puts into some queries' lists, in place, the new scores that are among their best."""
    k = scores.shape[1]
    good = (got >= least) & (got >= scores[:, -1:])
    if not same:
        good &= ids[:, None] != own
    for q in np.flatnonzero(good.any(1)):
        new = np.flatnonzero(good[q])
        both, whose = np.concatenate([scores[q], got[q, new]]), np.concatenate([keys[q], own[new]])
        order = np.lexsort((whose, -both))[:k]
        scores[q], keys[q] = both[order], whose[order]


def most_alike(texts: DataFrame, query: list[float], k: int = 200, least: float = 0.68, text: str = "description", vector: str = "embedding") -> DataFrame:
    """(text, score) of the k distinct texts most like one query vector, at least so like it, as a search's
    fallback by meaning takes them; of texts that repeat, the best. Ties go by the text itself."""
    keyed = texts.select(F.col(text).alias("t"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == len(query))
    unit = _unit(np.array([query], float))[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = np.zeros(0, object), np.zeros(0)
        for batch in batches:
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(unit))
            got = np.round(_unit(flat) @ unit, 6)
            good = np.isfinite(got) & (got >= least)
            best: dict[str, float] = dict(zip(held, values))
            for t, s in zip(batch["t"].filter(pa.array(good)).to_pylist(), got[good]):
                if t is not None:
                    best[t] = max(s, best.get(t, s))
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            held, values = np.array([t for t, _ in ranked], object), np.array([s for _, s in ranked])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(values, pa.float64())], ["t", "score"])

    if not any(query):
        return texts.sparkSession.createDataFrame([], f"{text} string, score double")
    found = keyed.mapInArrow(scored, "t string, score double").groupBy("t").agg(F.max("score").alias("score"))
    return found.orderBy(F.col("score").desc(), "t").limit(k).select(F.col("t").alias(text), "score")
