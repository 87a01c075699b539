"""Deleted interpolation: an n-gram model that mixes maximum-likelihood estimates of all orders.

The weights of the mix depend on how often the longest known context was seen, by powers of two,
and are learned by expectation-maximisation on training texts kept out of the counts.

How the work is dealt:
  1. Texts go to chunks by a hash of their id, a bounded number of characters each. A chunk sends
     the sorted hashes of its distinct n-grams and their counts to buckets, cut by the hash's
     leading bits; a bucket is a bounded share of all n-grams.
  2. A bucket adds up the training counts and answers each chunk with the totals of its n-grams.
     Answers are a table in the shared folder; no task or driver ever holds all n-grams.
  3. A chunk looks its texts' n-grams up in its answers, for EM's held-out events and for scores.

An n-gram is known by 64 bits, so of n distinct ones about n^2 / 2^61 pairs are taken for one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, under, written
from .hashing import U, mix, pack, pack_counts, runs, unpack, unpack_counts, word_hashes

CHUNK_CHARS, BUCKET_CHARS = 8_000_000, 6_000_000
START, END = U(0x5BD1E9955BD1E995), U(0x1B873593CC9E2D51)
#: Steps of a doubling in which EM's events are gathered, and rounds of EM.
STEPS, ROUNDS = 4, 60


@dataclass(frozen=True)
class Model:
    """order; training tokens and distinct tokens; weights {(level, bucket): mix of orders 0..level}."""

    order: int
    tokens: int
    types: int
    weights: dict


def _grams(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends at each token, 0 where the text is too short.

    Texts are START, their words, END, one after the other; also returned: tokens and START a text.
    """
    words, counts = word_hashes(texts)
    sizes = counts + 2
    at = np.cumsum(sizes) - sizes
    tokens = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[at] = inner[at + sizes - 1] = False
    tokens[at], tokens[at + sizes - 1], tokens[inner] = START, END, words
    place = np.arange(len(tokens)) - np.repeat(at, sizes)
    levels = [mix(tokens)]
    for k in range(2, order + 1):
        level = np.zeros(len(tokens), np.uint64)
        level[k - 1 :] = runs(tokens, k)
        level[place < k - 1] = 0
        levels.append(level)
    return levels, sizes


def _cells(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, chunk, n, grams, train, kept): what each chunk has of each bucket's n-grams."""

    def run(key, t):
        levels, sizes = _grams(t["text"].to_pylist(), order)
        every = np.concatenate(levels)
        part = np.tile(np.repeat(t["part"].to_numpy(), sizes), order)
        grams, inverse = np.unique(every, return_inverse=True)
        train = np.bincount(inverse[part > 0], minlength=len(grams))
        kept = np.bincount(inverse[part > 1], minlength=len(grams))
        start = 1 if len(grams) and grams[0] == 0 else 0
        grams, train, kept = grams[start:], train[start:], kept[start:]
        one = np.zeros(len(grams), bool)
        one[np.searchsorted(grams, np.unique(levels[0]))] = True
        bucket = (grams >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(grams)], strict=True):
            rows.append((int(bucket[a]), key[0].as_py(), int(b - a), pack(grams[a:b]), pack_counts(train[a:b]), pack_counts(kept[a:b]), np.packbits(one[a:b]).tobytes()))
        names = ["bucket", "chunk", "n", "grams", "train", "kept", "one"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    return chunks.groupBy("chunk").applyInArrow(run, "bucket long, chunk long, n long, grams binary, train binary, kept binary, one binary")


def _answers(cells: DataFrame) -> DataFrame:
    """(chunk, bucket, n, train, kept, types, tokens, kept_tokens): totals, in the order asked."""
    start = mix(np.array([START]))[0]

    def run(key, t):
        n = t["n"].to_pylist()
        asked = [unpack(g, k) for g, k in zip(t["grams"].to_pylist(), n, strict=True)]
        grams, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = []
        for name in ("train", "kept"):
            c = np.concatenate([unpack_counts(g, k) for g, k in zip(t[name].to_pylist(), n, strict=True)])
            totals.append(np.bincount(inverse, weights=c, minlength=len(grams)).astype(np.int64))
        one = np.zeros(len(grams), bool)
        one[inverse[np.concatenate([np.unpackbits(np.frombuffer(g, np.uint8), count=k) for g, k in zip(t["one"].to_pylist(), n, strict=True)]) > 0]] = True
        one &= grams != start
        figures = [int((one & (totals[0] > 0)).sum()), int(totals[0][one].sum()), int(totals[1][one].sum())]
        cuts = np.cumsum([0, *n])
        rows = {"chunk": t["chunk"], "bucket": t["bucket"], "n": t["n"]}
        for name, total in zip(("train", "kept"), totals, strict=True):
            rows[name] = pa.array([pack_counts(total[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        for name, x in zip(("types", "tokens", "kept_tokens"), figures, strict=True):
            rows[name] = pa.array([x] + [0] * (len(n) - 1), pa.int64())
        return pa.table(rows)

    return cells.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, n long, train binary, kept binary, types long, tokens long, kept_tokens long")


def _looked_up(texts: pa.Table, answers: pa.Table, order: int, name: str, only: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The count of the n-gram of each order at each token, from the chunk's answers, and tokens and
    START a text; of all texts, or of those in `only`."""
    levels, sizes = _grams(texts["text"].to_pylist(), order)
    answers = answers.sort_by("bucket")
    counts = np.concatenate([unpack_counts(c, n) for c, n in zip(answers[name].to_pylist(), answers["n"].to_pylist(), strict=True)])
    every = np.concatenate(levels)
    if only is None:
        grams, places = np.unique(every, return_inverse=True)
    else:
        grams, mine = np.unique(every), np.repeat(only, sizes)
        levels, sizes = [level[mine] for level in levels], sizes[only]
        places = np.searchsorted(grams, np.concatenate(levels))
    if len(grams) and grams[0] == 0:  # the mark of places without an n-gram: it is not asked for
        counts = np.concatenate([np.zeros(1, counts.dtype), counts])
    return np.split(counts[places], len(levels)), sizes


def _events(counts: list[np.ndarray], sizes: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token but START: which it is, its estimates of each order, and its (level, bucket)."""
    here = np.ones(len(counts[0]), bool)
    here[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(here)
    estimates, level, seen = [counts[0][at] / max(tokens, 1)], np.ones(len(at), np.int64), np.full(len(at), 1)
    for k in range(1, len(counts)):
        context = counts[k - 1][at - 1]
        estimates.append(counts[k][at] / np.maximum(context, 1))
        known = context > 0
        level[known], seen[known] = k + 1, context[known]
    bucket = np.where(level > 1, np.frexp(seen.astype(float))[1], 0)
    return at, np.array(estimates), level * 64 + bucket


def learned(level: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """EM: the mix of `level` + 1 estimates, columns of p, under which n times each row is likeliest."""
    w = np.full(level + 1, 1 / (level + 1))
    for _ in range(ROUNDS):
        share = w * p
        share = share / share.sum(axis=1, keepdims=True)
        # One more event each keeps every order in the mix.
        w = (share * n[:, None]).sum(axis=0) + 1e-3
        w = w / w.sum()
    return w


def _weights(events: DataFrame, uniform: float) -> DataFrame:
    """(key, weights) of each (level, bucket): EM over the cells of a bucket, whose number the grid of
    quantised estimates bounds whatever the input."""

    def run(key, t):
        level = key[0].as_py() // 64
        t = t.sort_by("cell_text")
        logs = np.array(t["cell"].to_pylist(), np.int64).reshape(t.num_rows, -1)[:, 1 : level + 1]
        p = np.concatenate([np.full((len(logs), 1), uniform), np.where(logs < -9000, 0.0, 2.0 ** (logs / STEPS))], axis=1)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "weights": pa.array([learned(level, p, t["n"].to_numpy().astype(float)).tolist()], pa.list_(pa.float64()))})

    # Sorted, so that sums are the same however the cells come in.
    keyed = events.select(F.get("cell", F.lit(0)).alias("key"), "cell", F.array_join(F.col("cell").cast("array<string>"), ",").alias("cell_text"), "n")
    return keyed.groupBy("key").applyInArrow(run, "key long, weights array<double>")


def fit_and_score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", order: int = 2, held_tenths: int = 1) -> tuple[DataFrame, Model]:
    """Scores of all texts under the model of the rows where `train` holds, and the model.

    Columns: `id`, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one
    unigrams), score: log10 probability of the text and its end; one named like `id` has an underscore before. A null text counts as empty and has
    the end token; rows that share an id or have none are scored each. Without a training row every
    token has the uniform chance. An empty table gives no rows.
    EM's held-out rows are training rows whose text hashes to `held_tenths` tenths, so copies of a
    text lie on one side; where that leaves no held-out or no kept row, all orders weigh alike.
    """
    chars = docs.agg(F.sum(F.coalesce(F.length(f"`{text}`"), F.lit(0)) + 8)).first()[0] or 0
    chunks = max(1, -(-int(chars) // CHUNK_CHARS))
    bits = max(0, math.ceil(math.log2(max(1, chars / BUCKET_CHARS))))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    part = F.when(~F.coalesce(train, F.lit(False)), 0).when(F.pmod(F.xxhash64(t), F.lit(10)) < held_tenths, 1).otherwise(2)
    rows = docs.select(F.col(f"`{id}`").alias("id"), t.alias("text"), part.alias("part"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    cells = _cells(rows.select("chunk", "text", "part"), order, bits)
    answers = written(_answers(cells), "answers")
    figures = answers.agg(F.sum("types"), F.sum("tokens"), F.sum("kept_tokens")).first()
    types, tokens, kept_tokens = (int(x or 0) for x in figures)
    uniform = 1 / (types + 1)

    def gather(key, left, right):
        held = left["part"].to_numpy() == 1
        if not held.any():
            return pa.table({"cell": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())})
        counts, sizes = _looked_up(left, right, order, "kept", held)
        _, p, keys = _events(counts, sizes, kept_tokens)
        with np.errstate(divide="ignore"):
            logs = np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-300)) * STEPS), -9999).astype(np.int64)
        cells, n = np.unique(np.concatenate([keys[None, :], logs]), axis=1, return_counts=True)
        return pa.table({"cell": pa.array(cells.T.tolist(), pa.list_(pa.int64())), "n": pa.array(n, pa.int64())})

    asked = answers.select("chunk", "bucket", "n", "train", "kept")
    events = (
        rows.select("chunk", "text", "part").groupBy("chunk").cogroup(asked.select("chunk", "bucket", "n", "kept").groupBy("chunk"))
        .applyInArrow(gather, "cell array<long>, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    )
    with tidy(docs.sparkSession):
        # A row a level and power of two: at most 64 a level.
        weights = {r.key: np.array(r.weights) for r in _weights(events, uniform).collect()}
    model = Model(order, tokens, types, weights)

    def score(key, left, right):
        n = left.num_rows
        if n:
            counts, sizes = _looked_up(left, right, order, "train")
            at, p, keys = _events(counts, sizes, tokens)
            chance = np.empty(len(at))
            for key_ in np.unique(keys):
                here = keys == key_
                w = model.weights.get(int(key_))
                if w is None:
                    w = np.full(key_ // 64 + 1, 1 / (key_ // 64 + 1))
                chance[here] = w[0] * uniform + w[1:] @ p[: key_ // 64, here]
            doc = np.repeat(np.arange(n), sizes)[at]
            c = counts[0][at]
            columns = [
                sizes - 1,
                np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64),
                np.bincount(doc, weights=np.log10((c + 1) / (tokens + types + 1)), minlength=n),
                np.bincount(doc, weights=np.log10(chance), minlength=n),
            ]
        else:
            columns = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.Table.from_arrays([left["id"], *map(pa.array, columns)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id].dataType.simpleString()
    scores = (
        rows.select("chunk", "id", "text").groupBy("chunk").cogroup(asked.select("chunk", "bucket", "n", "train").groupBy("chunk"))
        .applyInArrow(score, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    )
    return under(scores.withColumn("train_tokens", F.lit(tokens).cast("long")), id), model
