"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the features it holds, words and runs of letters in
them; a document's is the noisy-or of its sentences'. Only documents carry labels, so the gradient reaches a sentence through
that noisy-or. After training, sentences that score high on their own are the offending ones.

The fit takes a bounded sample of labelled rows (`FIT_DOCS` texts of `FIT_CHARS` characters in all),
those of least hash, whatever the size of the input; scoring covers every sentence of every whole text, in place and unshuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import under, written

#: Labelled texts that the fit sees at most and their characters in all, features that carry weights,
#: a feature's least documents.
FIT_DOCS, FIT_CHARS, VOCABULARY, LEAST_DOCS = 12_000, 60_000_000, 3_000, 5
#: Lengths of the runs of letters, the mark of a word's start counted; words that a task remembers.
RUNS, MEMO = (4, 5, 6), 200_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
STEPS, RATE, RIDGE = 400, 0.1, 1e-3


def _sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)]


def features(word: str) -> set[str]:
    marked = "^" + word
    return {marked[i : i + n] for n in RUNS for i in range(len(marked) - n + 1)} | {marked + "$"}


def _known(vocabulary: dict[str, int]):
    """A function from a word to its features' numbers in the vocabulary; it remembers words."""
    memo: dict[str, tuple[int, ...]] = {}

    def of(word: str) -> tuple[int, ...]:
        got = memo.get(word)
        if got is None:
            if len(memo) > MEMO:
                memo.clear()
            got = memo[word] = tuple(sorted({vocabulary[f] for f in features(word) if f in vocabulary}))
        return got

    return of


def _counts(texts: DataFrame) -> DataFrame:
    """(feature, n, pos) a batch: the texts, and toxic texts, that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pos = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held = set().union(*map(features, set(WORD.findall(text.lower()))))
                n.update(held)
                if toxic:
                    pos.update(held)
            names = list(n)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "n": pa.array([n[x] for x in names], pa.int64()), "pos": pa.array([pos[x] for x in names], pa.int64())})

    return texts.select("text", "toxic").mapInArrow(run, "feature string, n long, pos long")


def _bags(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Per text: the features of each sentence that has some, and how many sentences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _known(vocabulary)
        for batch in batches:
            bags, rest = [], []
            for text in batch.column("text").to_pylist():
                all_ = [sorted({k for w in WORD.findall(s) for k in of(w)}) for s in SENTENCE.findall(text.lower())]
                bags.append([b for b in all_ if b])
                rest.append(len(all_) - len(bags[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(rest, pa.int64())], names=["key", "toxic", "bags", "rest"])

    return texts.select("key", "toxic", "text").mapInArrow(run, "key long, toxic int, bags array<array<int>>, rest long")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> dict:
    """The model {'weights': {feature: weight}, 'bias': b} from the labelled rows given.

    Rows without a label or an id are left out, null texts count as empty, equal rows as one. Of
    several labels for an id the largest holds. Without any labelled row, or with labels of one kind
    only, no feature weighs. The fit reads the `fit_docs` texts of least hash of id and text, and of
    these those that have `fit_chars` characters in all: a longer sample stops before them.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.xxhash64(F.col(f"`{id}`"), t)
    # Ids, keys and lengths are dealt to meet their labels; texts stay where they are read until the few are known.
    rows = docs.select(F.col(f"`{id}`").alias("id"), key.alias("key"), F.length(t).cast("long").alias("chars")).join(known, "id")
    chosen = rows.select("key", "chars", "toxic").distinct().orderBy("key").limit(fit_docs)
    # The window is over the bounded sample's keys and lengths.
    sofar = F.sum("chars").over(Window.orderBy("key"))
    chosen = chosen.withColumn("sofar", sofar).where(F.col("sofar") <= fit_chars).select("key", "toxic")
    sample = written(docs.select(key.alias("key"), t.alias("text")).join(F.broadcast(chosen), "key").dropDuplicates(["key"]), "labelled")
    n = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    pos, neg = float(n.pos or 0), float(n.n - (n.pos or 0))
    if not pos or not neg:
        return {"weights": {}, "bias": -12.0 if neg or not pos else 4.0}
    p, q = (F.col("pos") + 0.5) / (pos + 1), (F.col("n") - F.col("pos") + 0.5) / (neg + 1)
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("n") - F.col("pos") + 0.5))
    chosen = (
        _counts(sample)
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .where(F.col("n") >= LEAST_DOCS)
        .orderBy(F.abs(F.log(p / q) / spread).desc(), "feature")
        .limit(VOCABULARY)
    )
    vocabulary = {r.feature: k for k, r in enumerate(chosen.select("feature").collect())}
    # In the order of keys, so that sums do not hang on how the sample was dealt.
    return _learn(_bags(sample, vocabulary).toArrow().sort_by("key"), vocabulary)


def _learn(t: pa.Table, vocabulary: dict[str, int]) -> dict:
    """Full-batch Adam on the noisy-or likelihood of the sample, whose characters are bounded."""
    y = t["toxic"].to_numpy().astype(float)
    rest = t["rest"].to_numpy().astype(float)
    bags = t["bags"].to_pylist()
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    sentence = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    word = np.array([w for s in flat for w in s], dtype=np.int64)
    w, b = np.zeros(len(vocabulary)), -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        grad = loss(w, b, y, rest, doc, sentence, word)[1]
        grad[:-1] += RIDGE * w / len(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return {"weights": {x: float(w[k]) for x, k in vocabulary.items()}, "bias": float(b)}


def loss(w: np.ndarray, b: float, y: np.ndarray, rest: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the mean log likelihood of the labels, and its gradient by weights and bias.

    `word` holds features one after the other, `sentence` the sentence of each, `doc` the document of
    each sentence, `rest` the sentences of a document that hold no feature, `y` its label."""
    n = len(doc)
    z = b + np.bincount(sentence, weights=w[word], minlength=n)
    # log(1 - P) = sum of log(1 - p_s) = -sum of softplus(z_s)
    log_clean = -np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) - rest * np.logaddexp(0, b)
    clean = np.exp(np.minimum(log_clean, -1e-9))
    # d(-log likelihood)/d log_clean
    g = np.where(y > 0, clean / (1 - clean), -1.0)
    p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
    per = -g[doc] * p
    grad = np.concatenate([np.bincount(word, weights=per[sentence], minlength=len(w)), [per.sum() - (g * rest).sum() * p0]]) / len(y)
    return float(-np.where(y > 0, np.log1p(-clean), log_clean).mean()), grad


def scored(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", at_least: float = 0.5) -> DataFrame:
    """`id`, score (0 to 1), and spans: start, end and score of the offending sentences, in order.

    A null or empty text has no sentence and scores 0. Rows that share an id are scored each. A result
    column named like `id` has an underscore before its name. The model is a few thousand weights and goes with the tasks.
    """
    vocabulary, weights, bias = {f: k for k, f in enumerate(model["weights"])}, list(model["weights"].values()), model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, of = log1p(exp(bias)), _known(vocabulary)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                text = (text or "").lower() if text is None or len(text.lower()) == len(text) else "".join(c.lower()[0] for c in text)
                at = _sentences(text)
                total, found = 0.0, []
                for a, b in at:
                    hits = {k for x in WORD.findall(text, a, b) for k in of(x)}
                    if not hits:
                        total += none
                        continue
                    z = bias + sum(weights[k] for k in sorted(hits))
                    total += max(z, 0.0) + log1p(exp(-abs(z)))
                    if z >= cut:
                        found.append({"start": a, "end": b, "score": 1 / (1 + exp(-z))})
                scores.append(-expm1(-total))
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["id", "score", "spans"])

    cut = float(np.log(at_least / (1 - at_least)))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int,score:double>>")
    return under(out, id)
