"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths alone travel, not texts. They are dealt by a hash into shards of a bounded number of
pieces, and each shard is packed on its own, so the work of a task does not grow with the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words
from .shards import Encoder

SIZES = (1024, 2048, 4096)
#: Pieces a shard holds about; at a half bin of waste a shard, under a hundredth of its tokens.
SHARD = 20_000
#: Tokens that opening a sequence costs besides its length; makes few long ones cheaper.
OPENING = 16


def best_fit(lengths: list[int], sizes: tuple[int, ...], opening: int = OPENING) -> list[tuple[int, int]]:
    """(bin, offset) of each length; lengths must fall and none may exceed the largest size.

    A length goes to the open bin that it leaves with least room. Where none has room, a bin of the
    size with the least cost a token is opened, were it filled as far as the lengths still to come
    that fit beside this one can fill it; of equal costs the largest size.
    """
    left = np.concatenate([np.cumsum(np.asarray(lengths, dtype=np.int64)[::-1])[::-1], [0]])
    falling = -np.asarray(lengths, dtype=np.int64)
    room: list[tuple[int, int]] = []
    out, used = [], []
    for k, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:

            def cost(c: int, k=k, n=n) -> tuple[float, int]:
                later = max(k + 1, int(np.searchsorted(falling, -(c - n)))) if c > n else len(lengths)
                return (c + opening) / max(1, n + min(c - n, int(left[later]))), -c

            space, b = min((c for c in sizes if c >= n), key=cost), len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        if space > n:
            insort(room, (space - n, b))
    return out


def token_count(text: Column) -> Column:
    """Words and one end token."""
    return F.size(words(text)).cast("long") + 1


def _pieces(docs: DataFrame, id: str, text: str, top: int, tokenizer: str, end: int | None, with_ids: bool) -> DataFrame:
    """(id, body, piece, first, n_tokens, ids) of each row: body tells texts apart that share an id."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end)
        for batch in batches:
            texts = batch.column("text")
            values = list(encoder.values(texts)) if with_ids else None
            sizes = np.array([len(v) for v in values], np.int64) if with_ids else encoder.sizes(texts)
            n = np.maximum(-(-sizes // top), 1)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = piece * top
            ids = [values[r][f : f + top].astype("<i4") for r, f in zip(row, first, strict=True)] if with_ids else [None] * len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("body").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(np.minimum(sizes[row] - first, top), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                names=["id", "body", "piece", "first", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, body long, piece int, first long, n_tokens long, ids array<int>")


def packed(docs: DataFrame, tokenizer: str | None = None, id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES, shard: int = SHARD, end: int | None = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its place in a bin, and the bin's fill and final size.

    `id`, piece (a document of over the largest size is cut into pieces of that size and a rest),
    first (its first token in the document), n_tokens, shard, bin (within the shard), offset,
    filled (the bin's tokens) and capacity: the least permitted size that holds them; with_ids adds
    the piece's token ids. Tokens are those of `tokenizer`, a file that each task reads, and the id
    `end` after each document, the same ones as `shards` writes; without a tokenizer, words and one
    end. A null or empty text has its end alone. Rows that share an id, or have a null one, are packed
    each; equal rows are told apart by a number only, so that they too are dealt to many shards. Equal
    lengths are placed in the order of their ids. An empty table gives no rows. An id column of the
    name of another column here is named id_.
    """
    sizes = tuple(sorted(set(sizes)))
    top = sizes[-1]
    chars = F.coalesce(F.length(f"`{text}`"), F.lit(0))
    most = docs.agg(F.sum(1 + F.floor(chars / (2 * top)))).first()[0] or 1
    shards = max(1, -(-int(most) // shard))
    if tokenizer:
        pieces = _pieces(docs, id, text, top, tokenizer, end, with_ids)
    else:
        n = token_count(F.col(f"`{text}`"))
        pieces = (
            docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"), n.alias("all"))
            .withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("all"), F.lit(1)) / top).cast("int") - 1)))
            .withColumn("first", F.col("piece").cast("long") * top)
            .select("id", "body", "piece", "first", F.least(F.col("all") - F.col("first"), F.lit(top)).alias("n_tokens"), F.lit(None).cast("array<int>").alias("ids"))
        )
    # Equal rows are counted before the shuffle and numbered after it, so they do not meet in one shard.
    pieces = pieces.groupBy("id", "body", "piece", "first", "n_tokens").agg(F.any_value("ids").alias("ids"), F.count("*").alias("copies"))
    pieces = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("shard", F.pmod(F.xxhash64("id", "body", "piece", "copy"), F.lit(shards)))

    def pack(t):
        t = t.take(pc.sort_indices(t, [("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending"), ("body", "ascending"), ("copy", "ascending")]))
        placed = np.array(best_fit(t["n_tokens"].to_pylist(), sizes), dtype=np.int32).reshape(-1, 2)
        filled = np.bincount(placed[:, 0], weights=t["n_tokens"].to_numpy()).astype(np.int32)
        capacity = np.array(sizes, dtype=np.int32)[np.searchsorted(sizes, filled)]
        more = {"bin": placed[:, 0], "offset": placed[:, 1], "filled": filled[placed[:, 0]], "capacity": capacity[placed[:, 0]]}
        t = t.select(["id", "piece", "first", "n_tokens", "shard", *["ids"] * with_ids])
        for name, values in more.items():
            t = t.append_column(name, pa.array(values, pa.int32()))
        return t

    kind = docs.schema[id].dataType.simpleString()
    fields = f"id {kind}, piece int, first long, n_tokens long, shard long, {'ids array<int>, ' * with_ids}bin int, offset int, filled int, capacity int"
    travel = ["id", "body", "piece", "first", "n_tokens", "copy", "shard", *["ids"] * with_ids]
    out = pieces.select(*travel).groupBy("shard").applyInArrow(pack, fields)
    return out.withColumnRenamed("id", id if id.lower() not in [c.lower() for c in out.columns[1:]] else f"{id}_")


def sequences(docs: DataFrame, tokenizer: str, id: str = "doc_id", sizes: tuple[int, ...] = SIZES, shard: int = SHARD // 8, **options) -> DataFrame:
    """One row per packed sequence: shard, bin, capacity, ids (the tokens of its pieces one after the
    other), and docs: in order the id, piece, offset and n_tokens of each. A sequence is no longer
    than the largest size, and with ids a shard holds fewer pieces, so that no group is large."""
    rows = packed(docs, tokenizer, id, sizes=sizes, shard=shard, with_ids=True, **options)
    named = rows.columns[0]
    piece = F.struct("offset", F.col(named).alias("id"), "piece", "n_tokens", "ids")
    rows = rows.groupBy("shard", "bin", "capacity").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select("shard", "bin", "capacity", F.flatten(F.col("p.ids")).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("docs"))
