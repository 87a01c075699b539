"""Product quantization of vectors by integers, its assignments found along tries of distinct parts.

A vector's equal parts each have a codebook, trained by rounds that assign all parts to their nearest
entry and replace entries by means. Equal parts are counted once with their weight, and sorted. Their
sorted order is a trie over the dimensions: a traversal, depth first, carries the distances to all
entries summed up so far, so parts that begin alike share that work; a leaf takes the nearest entry
and adds its weighted components to the entry's sums. Subtrees of up to `LEAVES` parts are walked
level by level as arrays, which bounds what is held and leaves no step of Python for each part.

How the work is dealt. Distinct parts are counted before they are shuffled, so a hot vector is one row.
They are written once, in ranges of sorted order; a round reads them, and its tasks give sums for each
entry alone, no more than a codebook's size. Codebooks (16 entries of a vector's length) are all that
the driver holds. The final codes are worked out where the rows are, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A subtree of so many parts at most is walked level by level; labels up to so many are broadcast.
LEAVES, MOST_LABELS = 4096, 100_000


def coded(frame: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distance to the entries), label_error (error
    summed over equal labels, nulls together), codebooks_sha256 (of all final entries' components).

    Components become floor(4096 * x). Codebooks begin as the parts of the 16 smallest ids (null ids
    last, then by components); fewer rows give fewer entries. Rows whose vector is null or holds a null
    or non-finite component are left out; so are those whose length is not that of the smallest
    id's vector (empty ones aside), and all, if that is no multiple of 8: their parts are not defined. Repeated rows count
    each. Integers are exact up to 2^62, and so are errors."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = frame.where(sound).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("v"))
    ordered = F.col("vec_id").asc_nulls_last(), "v"
    first = rows.where(F.size("v") > 0).orderBy(*ordered).select(F.size("v")).first()
    length = first[0] if first and first[0] % PARTS == 0 else 0
    width = length // PARTS
    rows = rows.where((F.size("v") == length) & F.lit(length > 0))
    begin = [r.v for r in rows.orderBy(*ordered).limit(ENTRIES).collect()]
    books = trained(_distinct(rows, width), [[v[p * width : (p + 1) * width] for v in begin] for p in range(PARTS)]) if width else [[]] * PARTS
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    out = written(rows.mapInArrow(lambda batches: _code(batches, books), schema), "codes")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    if fits(sums, MOST_LABELS):
        sums = F.broadcast(sums)
    sums = sums.withColumnRenamed("label", "of")
    return out.join(sums, out.label.eqNullSafe(sums.of)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _distinct(rows: DataFrame, width: int) -> DataFrame:
    """The distinct parts by position with their weights, in ranges of sorted order."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("part"), F.slice("v", p * width + 1, width).alias("v")))
    counted = rows.select(F.explode(parts).alias("p")).groupBy("p.part", "p.v").agg(F.count("*").alias("weight"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(counted.repartitionByRange(tasks, "part", "v").sortWithinPartitions("part", "v"), "parts")


def trained(parts: DataFrame, books: list[list[list[int]]], rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebooks after so many rounds over distinct parts (part, v, weight)."""
    for _ in range(rounds):
        sums = parts.mapInArrow(lambda batches, books=books: _sums(batches, books), "part int, entry int, weight bigint, totals array<string>")
        totals = F.posexplode("totals").alias("i", "total")
        got = sums.select("part", "entry", "weight", totals).groupBy("part", "entry", "i").agg(F.sum("weight").alias("weight"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [[list(entry) for entry in book] for book in books]
        for r in got.collect():  # a row for each component of the codebooks at most
            books[r.part][r.entry][r.i] = int(r.total) // r.weight
    return books


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part (a row; sorted rows share most) its nearest entry, the least of equals, and the
    squared distance."""
    n, width = parts.shape
    most = max(int(abs(x).max(initial=0)) for x in (parts, book))
    if 4 * most * most * max(width, 1) >= 1 << 62:
        parts, book = parts.astype(object), book.astype(object)
    opens = np.ones((n, width), bool)  # whether a row opens a node of its own at this depth
    if n:
        opens[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    code, error = np.zeros(n, np.int32), np.zeros(n, parts.dtype)

    def levels(lo: int, hi: int, depth: int, sofar: np.ndarray) -> None:
        """A bundle of subtrees as arrays, a level at a time."""
        nodes, sums = np.array([lo]), sofar[None]
        for d in range(depth, width):
            heads = opens[lo:hi, d].copy()
            heads[0] = True
            heads = lo + np.flatnonzero(heads)
            sums = sums[np.searchsorted(nodes, heads, "right") - 1] + (parts[heads, d][:, None] - book[:, d]) ** 2
            nodes = heads
        leaf = np.searchsorted(nodes, np.arange(lo, hi), "right") - 1
        entry = sums.argmin(1)
        code[lo:hi], error[lo:hi] = entry[leaf], sums[np.arange(len(entry)), entry][leaf]

    def walk(lo: int, hi: int, depth: int, sofar: np.ndarray) -> None:
        if hi - lo <= LEAVES or depth == width:
            return levels(lo, hi, depth, sofar)
        heads = opens[lo:hi, depth].copy()
        heads[0] = True
        bounds = [*(lo + np.flatnonzero(heads)), hi]
        begin = 0
        while begin < len(bounds) - 1:
            end = begin + 1
            while end < len(bounds) - 1 and bounds[end + 1] - bounds[begin] <= LEAVES:
                end += 1
            if end == begin + 1 and bounds[end] - bounds[begin] > LEAVES:
                walk(bounds[begin], bounds[end], depth + 1, sofar + (parts[bounds[begin], depth] - book[:, depth]) ** 2)
            else:
                levels(bounds[begin], bounds[end], depth, sofar)
            begin = end

    if n:
        walk(0, n, 0, np.zeros(len(book), parts.dtype))
    return code, error


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _sums(batches: Iterator[pa.RecordBatch], books: list) -> Iterator[pa.RecordBatch]:
    """Weights and weighted components by part and entry, summed over a task's batches."""
    width = len(books[0][0])
    weights = [[0] * len(book) for book in books]
    totals = [[[0] * width for _ in book] for book in books]
    for batch in batches:
        at, w, rows = batch["part"].to_numpy(), batch["weight"].to_numpy(), _matrix(batch["v"], width)
        for p in np.unique(at):
            own = at == p
            v, heavy = rows[own], w[own]
            code, _ = nearest(v, np.array(books[p], np.int64))
            exact = np.int64 if int(abs(v).max()) * int(heavy.sum()) < 1 << 62 else object
            for entry in np.unique(code):
                of = code == entry
                weights[p][entry] += int(heavy[of].sum())
                totals[p][entry] = [a + int(b) for a, b in zip(totals[p][entry], heavy[of].astype(exact) @ v[of].astype(exact))]
    found = [(p, e, n, [str(x) for x in totals[p][e]]) for p, book in enumerate(weights) for e, n in enumerate(book) if n]
    if found:
        parts, entries, n, sums = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.string()))], ["part", "entry", "weight", "totals"])


def _code(batches: Iterator[pa.RecordBatch], books: list) -> Iterator[pa.RecordBatch]:
    """A row's codes and error, by the trie of the distinct parts of its batch."""
    hexes = np.array([f"{i:02x}" for i in range(256)], dtype=object)
    for batch in batches:
        width = len(books[0][0]) if books[0] else 0
        rows = _matrix(batch["v"], PARTS * width)
        code, error = np.full(len(rows), "", object), np.zeros(len(rows), object)
        for p in range(PARTS):
            distinct, back = np.unique(rows[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
            entry, far = nearest(distinct, np.array(books[p], np.int64))
            code, error = code + hexes[entry[back.ravel()]], error + far[back.ravel()]
        most = (1 << 63) - 1
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(code, pa.string()), pa.array([min(int(e), most) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
