"""Near-copies of documents by order min-hash, verified by banded alignment.

Each of `ROUNDS` hashes deals the five-word runs of a text, labelled by their occurrence so that
repeats count, to `PARTS` parts. A sketch takes the two runs of a part with the least hashes and keeps
them in the order of the text. Texts that share a sketch are candidates: unlike a plain min-hash it
asks for two runs in the same order, which follows edit similarity. Candidates are links if a banded
alignment of their words has a similarity (1 - edits / longer length) of 0.8 or more; classes are the
components of the links. Of pairs at just 0.8, with edits at random places, nine in ten share a
sketch; edits laid out so that no five words in a row stay, as every fifth word, leave nothing to find.

How the work is dealt. Texts of equal words are one node. In a group of one sketch every node is
aligned with the group's least node first, which settles a group of copies in as many alignments as
it has nodes. Pairs of a group that still lie in different classes are then tried, all of them: a large
group's nodes are dealt by zones of length, as alike texts lie in one zone or in two neighbours, and a
zone of more nodes than a block holds is cut into blocks whose pairs are tasks' work; a bound on the edits from word
counts (no pair of the wanted similarity fails it) leaves few pairs to align, and a link found makes
two classes one for the rest of the task. No group is dropped or capped, and none is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, under, written
from .components import components
from .editing import edit_distance
from .hashing import U, mix, runs, word_hashes

RUN, ROUNDS, PARTS, SIMILARITY = 5, 4, 20, 0.8
SKETCHES = ROUNDS * PARTS
#: Words are counted in so many bins; nodes to a block; characters hashed at once.
BINS, BLOCK, AT_ONCE = 128, 1024, 2_000_000
_FACTORS = mix(np.arange(101, 101 + ROUNDS, dtype=np.uint64)) | U(1)
_SALTS = mix(np.arange(501, 501 + SKETCHES, dtype=np.uint64))
#: Bits of a hash that order the runs of a part.
_LOW = 40


def order_sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) of 64-bit sketches of texts with words; a text shorter than a run is one run.
    A part with one run has a sketch of that one, a part with none has 0, which stands for no sketch."""
    at = np.cumsum(sizes) - sizes
    n_runs = np.maximum(sizes - RUN + 1, 1)
    owner = np.repeat(np.arange(len(sizes)), n_runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    padded = np.concatenate([hashes, np.zeros(RUN, np.uint64)])
    keys = runs(padded, RUN)[at[owner] + place]
    for i in np.flatnonzero(sizes < RUN):
        keys[np.cumsum(n_runs)[i] - 1] = runs(np.concatenate([hashes[at[i] : at[i] + sizes[i]], np.zeros(RUN - sizes[i], np.uint64)]), RUN)[0]
    # Occurrence labels: equal runs of a text are numbered in the order of the text.
    own = keys ^ mix(owner.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    label = np.zeros(len(keys), np.int64)
    if same.any():
        index = np.arange(len(keys))
        first = np.concatenate([[0], np.where(same, 0, index[1:])])
        label[order] = index - np.maximum.accumulate(first)
    labelled = np.where(label > 0, mix(keys + label.astype(np.uint64) * U(0x9E3779B97F4A7C15)), keys)
    out = np.zeros((len(sizes), SKETCHES), np.uint64)
    for r in range(ROUNDS):
        v = mix(labelled * _FACTORS[r])
        part = owner * PARTS + ((v >> U(_LOW)) % U(PARTS)).astype(np.int64)
        order = np.argsort(part.astype(np.uint64) << U(_LOW) | v & U((1 << _LOW) - 1))
        part = part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        part, second = part[first], np.minimum(first + 1, len(order) - 1)
        two = np.diff(first, append=len(order)) > 1
        a, b = order[first], np.where(two, order[second], order[first])
        a, b = np.minimum(a, b), np.maximum(a, b)
        salt = _SALTS[r * PARTS + part % PARTS]
        sketch = mix(mix(salt + keys[a]) * U(3) + np.where(two, keys[b], U(0)))
        out[part // PARTS, r * PARTS + part % PARTS] = np.maximum(sketch, U(1))
    return out


def names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each text's words in their order."""
    stop = np.cumsum(sizes)
    place = (np.arange(len(hashes)) - np.repeat(stop - sizes, sizes)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place + U(7919))), dtype=np.uint64)])
    return mix(sums[stop] - sums[stop - sizes] + sizes.astype(np.uint64)).view(np.int64)


def sketched(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, key, node, n, sketches) a row: node names the word sequence, n its length, key id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") < AT_ONCE):
                    held += len(texts[end] or "")
                    end += 1
                hashes, sizes = word_hashes(texts[at:end])
                full = np.flatnonzero(sizes)
                sketches: list = [[]] * len(sizes)
                if len(full):
                    for k, row in zip(full, order_sketches(hashes, sizes[full]).view(np.int64), strict=True):
                        sketches[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, end - at),
                        batch.column("key").slice(at, end - at),
                        pa.array(names(hashes, sizes), pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "node", "n", "sketches"],
                )
                at = end

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("id"), row_key(id, text).alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, node long, n long, sketches array<long>")


def row_key(id: str, text: str) -> Column:
    """A 64-bit name of a row's id and text; null and empty texts are one."""
    return F.xxhash64(F.col(f"`{id}`").isNull(), F.col(f"`{id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether a banded alignment of two word sequences takes few enough edits. The words that one
    has over the other, each way, bound the edits from below; most unlike pairs end with that."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    d = np.bincount(a % 1021, minlength=1021) - np.bincount(b % 1021, minlength=1021)
    if max(int(d[d > 0].sum()), int(-d[d < 0].sum())) > most:
        return False
    return edit_distance(a.tolist(), b.tolist(), most) <= most


def _bodies(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(node, words) of the wanted (node, key): word hashes, four bytes each, of one text of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes, at = batch.column("text").to_pylist(), batch.column("node").to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") < AT_ONCE):
                    held += len(texts[end] or "")
                    end += 1
                hashes, sizes = word_hashes(texts[at:end])
                low, stop = hashes.astype("<u4"), np.cumsum(sizes)
                words = [low[b - n : b].tobytes() for b, n in zip(stop, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at:end], pa.int64()), pa.array(words, pa.binary())], names=["node", "words"])
                at = end

    found = docs.select(row_key(id, text).alias("key"), F.col(f"`{text}`").alias("text")).join(wanted, "key").select("node", "text")
    # Equal rows give a node's words more than once.
    return found.mapInArrow(run, "node long, words binary").groupBy("node").agg(F.any_value("words").alias("words"))


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = [alike(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), similarity) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _lengths_fit(similarity: float):
    n, m = F.col("na"), F.col("nb")
    return F.abs(n - m) <= (1 - similarity) * F.greatest(n, m) + 1e-9


def _zone(similarity: float) -> float:
    """The width of a zone of lengths, in logarithms: a little over the most that two alike differ by."""
    return 1.000001 * min(50.0, max(1e-3, -math.log(max(similarity, 1e-9))))


def _rest(shared: DataFrame, nodes: DataFrame, words: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join classes which share a group still: every pair of a group whose classes
    differ is tried in the first sketch that the two share, until a link makes their classes one, so
    a task gives out fewer links than it has nodes."""

    def run(key, t):
        cls, core, node = t["class"].to_numpy().copy(), t["core"].to_numpy(zero_copy_only=False), t["node"].to_numpy()
        texts = [np.frombuffer(w, "<u4") for w in t["words"].to_pylist()]
        n = np.array([len(w) for w in texts])
        bins = np.array([np.bincount(w % BINS, minlength=BINS) for w in texts])
        earlier = np.array(t["earlier"].to_pylist(), np.int64).reshape(len(n), -1)
        cross, found, place = key[2].as_py(), [], np.arange(len(n))
        for i in np.flatnonzero(core):
            others = np.flatnonzero((cls != cls[i]) & (~core if cross else ~core | (place > i)))
            most = (1 - similarity) * np.maximum(n[i], n[others]) + 1e-9
            ok = np.abs(n[others] - n[i]) <= most
            ok[ok] = ~((earlier[others[ok]] == earlier[i]) & (earlier[i] != 0)).any(axis=1)
            others, most = others[ok], most[ok]
            d = bins[others] - bins[i]
            others = others[np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)) <= most]
            for j in others:
                if cls[j] != cls[i] and alike(texts[i], texts[j], similarity):
                    found.append((node[i], node[j]))
                    cls[cls == cls[j]] = cls[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = shared.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    # Lengths of a link differ by a factor at most, so that they lie in one zone of lengths or in two
    # neighbours: a node none of whose zones, in its group, holds another class has no one to be tried with.
    rows = rows.withColumn("zone", F.floor(F.log("n") / _zone(similarity)))
    # All nodes of a zone pass or none does, so that zones are chosen and counted before nodes meet them, once.
    zones = rows.groupBy("sketch", "zone").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("own"))
    reach = zones.withColumn("zone", F.explode(F.array(F.col("zone") - 1, F.col("zone"), F.col("zone") + 1))).groupBy("sketch", "zone").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sizes = written(zones.select("sketch", "zone", "own").join(reach.where("lo <> hi").select("sketch", "zone"), ["sketch", "zone"]), "zones")
    beside = lambda step, name: sizes.select("sketch", (F.col("zone") - step).alias("zone"), F.col("own").alias(name))
    sizes = sizes.join(beside(-1, "before"), ["sketch", "zone"], "left").join(beside(1, "after"), ["sketch", "zone"], "left").join(sizes.groupBy("sketch").agg(F.sum("own").alias("all")), "sketch")
    rows = rows.join(sizes.fillna(0, ["before", "after"]), ["sketch", "zone"])
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    mine = F.pmod(F.xxhash64("node"), blocks("own"))
    turns = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    to = lambda zone, cross, i, j, core: F.struct(zone.alias("zone"), cross.alias("cross"), i.alias("i"), j.alias("j"), core.alias("core"))
    yes, no, nil = F.lit(True), F.lit(False), F.lit(0).cast("long")
    zone = F.col("zone")
    # In a zone's own task its nodes meet one another and those of the zone before; a zone that with
    # the one before has more than a block is cut into blocks, and pairs of them are tasks.
    home = F.concat(
        F.transform(turns(blocks("own")), lambda j: to(zone, j != mine, F.least(mine, j), F.greatest(mine, j), mine <= j)),
        F.transform(turns(blocks("before")), lambda j: to(zone, yes, -j - 1, mine, yes)),
    )
    home = F.when(F.col("own") + F.col("before") <= BLOCK, F.array(to(zone, no, nil, nil, yes))).otherwise(home)
    next_ = F.when(F.col("own") + F.col("after") <= BLOCK, F.array(to(zone + 1, no, nil, nil, no))).otherwise(F.transform(turns(blocks("after")), lambda j: to(zone + 1, yes, -mine - 1, j, no)))
    next_ = F.when(F.col("after") > 0, next_).otherwise(F.slice(next_, 1, 0))
    whole = F.array(to(F.lit(-1).cast("long"), no, nil, nil, yes))
    dealt = rows.withColumn("deal", F.explode(F.when(F.col("all") <= BLOCK, whole).otherwise(F.concat(home, next_)))).select("sketch", "deal.*", "node", "class")
    # Words and sketches are put together once a node, so that a node's many rows meet them in one join.
    held = words.join(nodes.select("node", "sketches"), "node")
    # Only the sketches before the group's own travel, which tell whether two nodes met in an earlier one.
    earlier = F.slice("sketches", F.lit(1), F.array_position("sketches", F.col("sketch")).cast("int") - 1).alias("earlier")
    sent = dealt.join(held, "node").select("sketch", "zone", "cross", "i", "j", "node", "class", "core", "words", earlier)
    return sent.groupBy("sketch", "zone", "cross", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per row of `docs`: `id`, class_id (the least id of its class), class_size and n_words.

    Texts are compared by their words, A-Z lower-cased. Texts of equal words are of one class; so
    are all null, empty and blank texts. Rows that share an id are classed each by its text; null ids
    are not the least unless a class has no other. An empty table gives no rows. A result column named
    like `id` has an underscore before its name.
    A text's node is a 64-bit hash of its words: of n different texts about n^2 / 2^65 pairs agree.
    """
    rows = _classed(docs, id, text, similarity)
    return under(rows.select("id", F.col("first.id").alias("class_id"), "class_size", "n_words"), id)


def _classed(docs: DataFrame, id: str, text: str, similarity: float) -> DataFrame:
    """(id, key, n_words, first, class_size) a row: first is the (no, id, key) of the least row of its class."""
    rows = written(sketched(docs, id, text), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("first")
    nodes = rows.groupBy("node").agg(first, F.any_value("n").alias("n"), F.any_value("sketches").alias("sketches"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    bands = nodes.select("node", "n", F.explode("sketches").alias("sketch")).where("sketch <> 0")
    groups = bands.groupBy("sketch").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1").select("sketch", "least")
    # A table of its own, so that the join below is of two shuffles and a large group can be split.
    shared = written(bands.join(written(groups, "groups"), "sketch"), "shared")
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"))
    star = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    star = written(star.join(sizes, "a").where(_lengths_fit(similarity)).select("a", "b"), "star")
    wanted = shared.select("node").distinct().join(nodes.select("node", F.col("first.key").alias("key")), "node")
    words = written(_bodies(docs, wanted, id, text), "words")
    links = _verified(star, words, similarity)
    roots = written(components(links), "roots")
    more = written(_rest(shared, nodes, words, roots, similarity), "more")
    if not more.isEmpty():
        # The classes so far stand for their links.
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    of = nodes.select("node", "first", "copies").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "copies")
    named = of.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    return rows.select("id", "key", "node", F.col("n").alias("n_words")).join(of.select("node", "root").join(named, "root"), "node")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, in their own columns, that are the first of their class: by id, null ids last,
    then by a hash of the text. Of equal rows one stays, so a class keeps one document always."""
    mine, kept = fresh(docs, "own_key", "kept_key")
    first = _classed(docs, id, text, similarity).where(F.col("key") == F.col("first.key")).select(F.col("key").alias(kept)).distinct()
    chosen = docs.withColumn(mine, row_key(id, text)).join(first, F.col(mine) == F.col(kept))
    return chosen.dropDuplicates([mine]).select(*[F.col(f"`{c}`") for c in docs.columns])
