"""Hard negatives of anchors: rows of another label that score just under a row of the same label.

Components are integers, so that scores (inner products) and their ties are exact. Slot-decomposed
selection: an anchor's positives give upper limits, which cut the scores into disjoint slots. Each
task keeps the best `NEGATIVES` rows of every slot, combiners merge such lists slot by slot, and the
windows of all positives, which overlap, are then answered from the slots alone: merged from the
lowest slot upwards, the lists give the best rows under each limit, of which those above the lower
limit are the window's first.

How the work is dealt. Anchors are a stated set, each of which is compared with all rows. Rows are
dealt by the hash of their id to blocks of about `ROWS`, anchors to blocks of about `ANCHORS`, and a
pair of blocks is one piece of work; its scores are worked out `STRIP` anchors at a time. A task reads
some files of blocks of rows and meets each with about `SIDE` blocks of anchors; neither is dealt by key
or broadcast. What a task keeps is a few numbers an anchor. Lists of one block of anchors are merged
`FAN_IN` at a time, level by level, so no task holds more than so many, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

POSITIVES, NEGATIVES = 5, 3
ROWS, ANCHORS, STRIP, SIDE, FAN_IN = 4096, 1024, 128, 4, 32
#: Stands for no row; scores are cut to what lies above it and below 2^62.
NONE = -(1 << 62)

_BLOCK = "block bigint, n int, ids binary, labels binary, matrix binary"
_LISTS = "anchors bigint, block bigint, k int, scores binary, ids binary"


def mined(frame: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each row
    where `anchors` holds (a condition on id) and each of its `POSITIVES` best rows of the same label,
    the `NEGATIVES` best rows of other labels that score from low to high per cent of the positive.

    Components become floor(scale * x). Higher scores come first, then smaller ids. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part. Rows equal in id, label and
    components count once; others of one id are rows of their own, in the order of their components.
    Vectors may differ in length: what is missing counts as zeros. A positive of a score below zero has
    no window. Scores beyond 2^62 are cut to it. An empty table gives no rows."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = frame.where(anchors.isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(sound)
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"), anchors.alias("asks"))
    rows = written(rows.where("id is not null").distinct(), "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not asking:
        return frame.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    blocks, anchor_blocks = -(-n // ROWS), -(-asking // ANCHORS)
    base = written(_blocks(rows, blocks), "row_blocks")
    asks = written(_blocks(rows.where("asks"), anchor_blocks), "anchor_blocks").withColumnsRenamed({"block": "anchors", **{c: f"a_{c}" for c in ("n", "ids", "labels", "matrix")}})

    def against(side: DataFrame, best) -> DataFrame:
        """Every block of anchors with every block of rows, and the lists of each merged. The hint keeps
        the matrices of either side from being broadcast, however small their files are."""
        pairs = base.hint("shuffle_replicate_nl").crossJoin(side.repartition(-(-anchor_blocks // SIDE)))
        lists, left = written(pairs.mapInArrow(lambda batches: _kept(batches, best), _LISTS), "lists"), blocks
        while left > 1:
            lists = lists.withColumn("block", F.expr(f"block div {FAN_IN}")).groupBy("anchors", "block").applyInArrow(_merged, _LISTS)
            left = -(-left // FAN_IN)
        return lists.select("anchors", F.col("scores").alias("p_scores"), F.col("ids").alias("p_ids"))

    with_positives = written(asks.hint("merge").join(against(asks, _positives), "anchors"), "anchors")
    slots = against(with_positives, lambda pair: _slots(pair, high)).select("anchors", F.col("p_scores").alias("s_scores"), F.col("p_ids").alias("s_ids"))
    return with_positives.select("anchors", "a_n", "a_ids", "p_scores", "p_ids").hint("merge").join(slots, "anchors").groupBy("anchors").applyInArrow(
        lambda got: _windows(got, low, high), "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """The rows as matrices: equal ids share a block, ids ascend in it."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).groupBy("block").applyInArrow(_block, _BLOCK)


def _block(got: pa.Table) -> pa.Table:
    ids, labels = got["id"].to_numpy(), got["label"].to_numpy()
    lists = got["v"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    matrix = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    order = np.lexsort((*matrix.T[::-1], labels, ids))
    parts = [got["block"].to_numpy()[:1], [len(ids)], *[[x[order].tobytes()] for x in (ids, labels, matrix)]]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "n", "ids", "labels", "matrix"])


def _read(pair: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, ids, labels, matrix = (pair[prefix + c][0].as_py() for c in ("n", "ids", "labels", "matrix"))
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(matrix, np.int64).reshape(n, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, exact: in doubles where all sums fit them."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    if most[0] * most[1] * width < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, -NONE).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each row and their ids, by taking the first greatest k times; ids ascend.
    Overwrites what it takes."""
    n = np.arange(len(scores))
    out = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64)
    for i in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        out[0][:, i], out[1][:, i] = scores[n, at], ids[at]
        scores[n, at] = NONE
    return out


def _lists(pair: pa.Table, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    parts = [pair["anchors"].to_numpy()[:1], pair["block"].to_numpy()[:1], [scores.shape[-1]], [scores.tobytes()], [ids.tobytes()]]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["anchors", "block", "k", "scores", "ids"])


def _kept(batches: Iterator[pa.RecordBatch], best: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """A task's pairs of blocks: one list for each block of anchors, under the first of their blocks of rows."""
    lists: dict[int, pa.Table] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            got = best(pa.Table.from_batches([batch.slice(i, 1)]))
            key = got["anchors"][0].as_py()
            lists[key] = _merged(pa.concat_tables([lists[key], got])) if key in lists else got
    for got in lists.values():
        yield from got.to_batches()


def _positives(pair: pa.Table) -> pa.Table:
    """Of one pair of blocks, each anchor's best other rows of its label: one slot."""
    (ids, labels, matrix), (a_ids, a_labels, a_matrix) = _read(pair), _read(pair, "a_")
    out = np.full((len(a_ids), 1, POSITIVES), NONE), np.zeros((len(a_ids), 1, POSITIVES), np.int64)
    for label in np.unique(a_labels):
        own, at = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
        for few in np.array_split(at, -(-len(at) // STRIP)):
            scores = _scores(a_matrix[few], matrix[own])
            for i, k in np.argwhere(a_ids[few][:, None] == ids[own]):
                width = min(matrix.shape[1], a_matrix.shape[1])
                x, y = a_matrix[few[i]], matrix[own[k]]
                if (x[:width] == y[:width]).all() and not x[width:].any() and not y[width:].any():
                    scores[i, k] = NONE
            out[0][few, 0], out[1][few, 0] = _best(scores, ids[own], POSITIVES)
    return _lists(pair, *out)


def _limits(positives: np.ndarray, high: int) -> np.ndarray:
    """floor(high per cent of a score) without leaving 64 bits; none for none."""
    tens, ones = positives // 100, positives % 100
    return np.where(positives == NONE, NONE, tens * high + ones * high // 100)


def _slots(pair: pa.Table, high: int) -> pa.Table:
    """Of one pair of blocks, the best rows of other labels in each slot between an anchor's limits."""
    (ids, labels, matrix), (a_ids, a_labels, a_matrix) = _read(pair), _read(pair, "a_")
    limits = _limits(np.frombuffer(pair["p_scores"][0].as_py(), np.int64).reshape(len(a_ids), POSITIVES), high)
    floors = np.concatenate([limits[:, 1:], np.full((len(a_ids), 1), NONE)], 1)
    out = np.full((len(a_ids), POSITIVES, NEGATIVES), NONE), np.zeros((len(a_ids), POSITIVES, NEGATIVES), np.int64)
    for few in np.array_split(np.arange(len(a_ids)), -(-len(a_ids) // STRIP)):
        scores = _scores(a_matrix[few], matrix)
        scores[a_labels[few][:, None] == labels] = NONE
        for slot in range(POSITIVES):
            inside = (scores <= limits[few, slot, None]) & (scores > floors[few, slot, None])
            out[0][few, slot], out[1][few, slot] = _best(np.where(inside, scores, NONE), ids, NEGATIVES)
    return _lists(pair, *out)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best along the last axis: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _merged(got: pa.Table) -> pa.Table:
    """Lists of one block of anchors, slot by slot, made one."""
    k = got["k"][0].as_py()
    scores, ids = (np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, k) for x in got[c]], 1) for c in ("scores", "ids"))
    return _lists(got, *_first(scores, ids, k))


def _windows(got: pa.Table, low: int, high: int) -> pa.Table:
    """The slots of one block of anchors merged from the lowest upwards; a row for each rank found."""
    anchors = np.frombuffer(got["a_ids"][0].as_py(), np.int64)
    positives, p_ids = (np.frombuffer(got[c][0].as_py(), np.int64).reshape(-1, POSITIVES) for c in ("p_scores", "p_ids"))
    s_scores, s_ids = (np.frombuffer(got[c][0].as_py(), np.int64).reshape(-1, POSITIVES, NEGATIVES) for c in ("s_scores", "s_ids"))
    below, out = (s_scores[:, :0].reshape(len(anchors), 0),) * 2, []
    for slot in reversed(range(POSITIVES)):
        below = _first(np.concatenate([below[0], s_scores[:, slot]], 1), np.concatenate([below[1], s_ids[:, slot]], 1), NEGATIVES)
        p = positives[:, slot]
        least = -_limits(-p, low)  # rounded up
        fits = (p != NONE)[:, None] & (below[0] != NONE) & (below[0] >= least[:, None])
        at, rank = np.nonzero(fits)
        out.append((anchors[at], p_ids[at, slot], rank + 1, below[1][at, rank], p[at], below[0][at, rank]))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int32() if name == "rank" else pa.int64()) for name, x in zip(names, zip(*out))], names)
