"""Line dedup by a segment-partition edit join.

Two lines are like if no more than one edit for each `CHARS_PER_EDIT` characters of the shorter tells
them apart, and no more than `EDITS`; lines too short for an edit are like equal lines alone. A line
that allows e edits is cut into e + 1 segments. Of two like lines one holds a segment of the other
unchanged, not far from its place. So every line enters its segments in an index under (length,
segment number, hash), and probes the index for its own and each shorter length with the substrings
that may be that segment. Lines that meet are verified by a banded bit-parallel edit distance.

How the work is dealt. Equal lines are one node; hashes travel, packed by bucket, not texts. Only
the nodes that meet are then joined with their texts, and checked in blocks of a bounded size, by a
bound from counts of characters first. Pairs are counted where they are found, each under the first
key that the two share, and leave a block as a number of links a node and a forest that connects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, words, written
from .components import components
from .editing import edit_distance
from .hashing import U, mix, word_hashes
from .nearcopies import SIMILARITY, alike

#: Edits that two like lines may differ by at most; characters of the shorter line to an edit.
EDITS, CHARS_PER_EDIT = 2, 8
#: Lines of fewer characters are left in a text however often they repeat: heads, marks, single words.
LEAST_CHARS = 16
#: Characters worked on at once, characters of text to a bucket of keys, nodes to a block, bins of a
#: line, rows of small groups to a part.
AT_ONCE, BUCKET_CHARS, BLOCK, BINS, DEAL = 1_000_000, 10_000_000, 256, 32, 1_000
#: White space of lines that have no word.
BLANK = " \t\n\x0b\x0c\r"
#: Lines that a task remembers having sent; parts that the pairs of one text are dealt to.
KEPT, PARTS = 500_000, 256
_BASE = U(0x9E3779B97F4A7C15) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, U(base)), np.full(n, U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def segments(n: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, (lines, edits + 1), of the segments of lines of n characters."""
    k = edits + 1
    short, longer = n // k, n % k
    i = np.arange(k)
    # The last segments take one character more where the length does not divide.
    lengths = short[:, None] + (i[None, :] >= k - longer[:, None])
    return np.cumsum(lengths, axis=1) - lengths, lengths


def allowed(n: np.ndarray, edits: int) -> np.ndarray:
    """The edits that a line of n characters and a like one may differ by, where it is the shorter."""
    return np.clip(n // CHARS_PER_EDIT, 0, edits)


def moves(e: int, d: int, i: int) -> list[int]:
    """How far segment i of e + 1 may lie from its place in a line d characters longer: as far as leaves
    no more edits than there are to either side of it (multi-match-aware)."""
    return [m for m in range(-e, e + 1) if abs(m) <= i and abs(d - m) <= e - i and abs(m) + abs(d - m) <= e]


def keys(n: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bool]]:
    """(line, place, length, salt, segment, is index) for all segments and all probes of the lines."""
    for e in range(1, edits + 1):
        for d in range(e + 1):
            here = np.flatnonzero((n >= d) & (allowed(n - d, edits) == e))
            shorter = n[here] - d
            starts, lengths = segments(shorter, e)
            for i in range(e + 1):
                salt = mix(shorter.astype(np.uint64) * U(edits + 1) + U(i))
                if d == 0:
                    yield here, starts[:, i], lengths[:, i], salt, i, True
                for move in moves(e, d, i):
                    place = starts[:, i] + move
                    ok = np.flatnonzero((place >= 0) & (place + lengths[:, i] <= n[here]))
                    yield here[ok], place[ok], lengths[ok, i], salt[ok], i, False


def first_segment(short: str, long: str, e: int) -> int:
    """The first segment of a line that a like one holds near its place, or -1."""
    n, d = len(short), len(long) - len(short)
    for i in range(e + 1):
        size = n // (e + 1) + (i >= e + 1 - n % (e + 1))
        start = n // (e + 1) * i + max(0, i - (e + 1 - n % (e + 1)))
        part = short[start : start + size]
        if any(start + m >= 0 and long[start + m : start + m + size] == part for m in moves(e, d, i)):
            return i
    return -1


def occurrences(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, body, line, node, chars) of every line that has a word: body names the whole text, node
    the line; both are 64-bit hashes, so of n different lines about n^2 / 2^65 pairs agree."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(t).alias("body"), F.posexplode(F.split(t, "\n", -1)).alias("line", "words"))
    return rows.where(F.regexp_like("words", F.lit("[^\\x20\\x09-\\x0D]"))).select("id", "body", "line", F.xxhash64("words").alias("node"), F.length("words").alias("chars"))


def _named(docs: DataFrame, text: str) -> DataFrame:
    """(lines, names) a text: its lines and their nodes."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    return docs.select(lines.alias("lines")).select("lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("names"))


def _entries(docs: DataFrame, text: str, edits: int, buckets: int) -> DataFrame:
    """(bucket, n, keys, nodes): index and probe keys of the distinct lines of each batch."""

    def emit(codes: list[np.ndarray], nodes: list[int], up: np.ndarray, down: np.ndarray) -> pa.RecordBatch:
        n = np.array([len(c) for c in codes])
        at = np.cumsum(n) - n
        flat = np.concatenate(codes).astype(np.uint64) + U(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up[: len(flat)], dtype=np.uint64)])
        node, found, owner = np.array(nodes, np.int64), [], []
        for line, place, length, salt, segment, index in keys(n, edits):
            a = at[line] + place
            part = (sums[a + length] - sums[a]) * down[a]
            # The last bit tells index from probe, so that a key sorts with its own; four before it the segment.
            found.append(mix(part ^ salt) & ~U(31) | U(segment << 1 | index))
            owner.append(node[line])
        key, owner = np.concatenate(found), np.concatenate(owner)
        bucket = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, owner, bucket = key[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(int(bucket[a]), int(b - a), key[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "n", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(AT_ONCE)
        seen: set[int] = set()
        codes, nodes, held = [], [], 0
        for batch in batches:
            for lines, names in zip(batch.column("lines").to_pylist(), batch.column("names").to_pylist(), strict=True):
                for line, name in zip(lines, names, strict=True):
                    if len(line) < CHARS_PER_EDIT or name in seen or not line.strip(BLANK):
                        continue
                    if held + len(line) > AT_ONCE and codes:
                        yield emit(codes, nodes, up, down)
                        codes, nodes, held = [], [], 0
                    if len(line) > len(up):
                        up, down = _powers(len(line))
                    if len(seen) > KEPT:  # only saves work: a line sent twice is one node later
                        seen.clear()
                    seen.add(name)
                    codes.append(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4"))
                    nodes.append(name)
                    held += len(line)
        if codes:
            yield emit(codes, nodes, up, down)

    return _named(docs, text).mapInArrow(run, "bucket long, n long, keys binary, nodes binary")


def _met(entries: DataFrame) -> DataFrame:
    """(key, node, index) of the nodes under each key that an index entry and another node share, and
    whether the key is of a segment of the node itself."""

    def run(key, t):
        keys_ = np.concatenate([np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()])
        nodes = np.concatenate([np.frombuffer(k, np.int64) for k in t["nodes"].to_pylist()])
        plain = keys_ >> U(1)
        order = np.lexsort((nodes, plain))
        plain, nodes, index = plain[order], nodes[order], (keys_[order] & U(1)) > 0
        new = np.concatenate([[True], (plain[1:] != plain[:-1]) | (nodes[1:] != nodes[:-1])])
        first = np.flatnonzero(new)
        index = np.maximum.reduceat(index, first)
        plain, nodes = plain[first], nodes[first]
        starts = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        sizes = np.diff(np.append(starts, len(plain)))
        keep = np.repeat((sizes > 1) & np.maximum.reduceat(index, starts), sizes)
        return pa.table({"key": pa.array(plain[keep].view(np.int64), pa.int64()), "node": pa.array(nodes[keep], pa.int64()), "index": pa.array(index[keep], pa.bool_())})

    return entries.groupBy("bucket").applyInArrow(run, "key long, node long, index boolean")


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, words, n, bins) of the wanted nodes: the line and its counts of characters by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bins = [], []
            for line in batch.column("words").to_pylist():
                codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
                n.append(len(codes))
                bins.append(np.minimum(np.bincount(codes % BINS, minlength=BINS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("words"), pa.array(n, pa.int32()), pa.array(bins, pa.binary())], names=["node", "words", "n", "bins"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A line goes out once a task, so that a very frequent one is not one task's load in the join.
        seen: set[int] = set()
        for batch in batches:
            words, nodes = [], []
            for lines, names in zip(batch.column("lines").to_pylist(), batch.column("names").to_pylist(), strict=True):
                for line, name in zip(lines, names, strict=True):
                    if len(line) >= CHARS_PER_EDIT and name not in seen:
                        if len(seen) > KEPT:
                            seen.clear()
                        seen.add(name)
                        words.append(line)
                        nodes.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(words, pa.string())], names=["node", "words"])

    found = _named(docs, text).mapInArrow(once, "node long, words string").join(wanted, "node", "left_semi")
    found = found.groupBy("node").agg(F.any_value("words").alias("words"))
    return found.mapInArrow(run, "node long, words string, n int, bins binary")


def _linked(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(a, b, n): with b, links that connect what is like in a block, fewer than its nodes; without b,
    the number n of like lines that node a has under the keys of the block."""

    def run(key, t):
        order = np.argsort(t["key"].to_numpy(), kind="stable")
        keys_, node, n = (t[c].to_numpy()[order] for c in ("key", "node", "n"))
        side, index = (t[c].to_numpy(zero_copy_only=False)[order] for c in ("side", "index"))
        words = t["words"].take(pa.array(order))
        bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, BINS)[order].astype(np.int16)
        ends = np.searchsorted(keys_, keys_, "right")
        root, links, forest = {}, {}, []

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        # Neighbours at each distance within their group, all groups at once.
        for step in range(1, int((ends - np.searchsorted(keys_, keys_)).max())):
            i = np.flatnonzero(np.arange(len(keys_)) + step < ends)
            j = i + step
            # The shorter line, of equal ones the lesser node, is the one whose segment is looked for.
            swap = (n[i] > n[j]) | ((n[i] == n[j]) & (node[i] > node[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            most = allowed(n[i], edits)
            ok = index[i] & (n[j] - n[i] <= most) & (node[i] != node[j]) & ((side[i] != side[j]) | (side[i] == 2))
            i, j, most = i[ok], j[ok], most[ok]
            d = bins[i] - bins[j]
            ok = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1)) <= most
            for p, q, e in zip(i[ok].tolist(), j[ok].tolist(), most[ok].tolist(), strict=True):
                x, y = words[p].as_py(), words[q].as_py()
                if first_segment(x, y, e) != keys_[p] & 15 or edit_distance(x, y, e) > e:
                    continue
                a, b = int(node[p]), int(node[q])
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                u, v = find(a), find(b)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    forest.append((a, b))
        rows = [(a, b, 0) for a, b in forest] + [(a, None, k) for a, k in links.items()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 3)], names=["a", "b", "n"])

    sizes = met.groupBy("key").agg(F.count("*").alias("all"))
    deals = max(64, met.count() // DEAL)
    nb = F.ceil(F.col("all") / BLOCK)
    rows = met.join(written(sizes, "sizes"), "key").join(texts, "node")
    # Small groups go many to a part; large ones by pairs of blocks. side 2: every pair of the block.
    more = ["key", "index", "node", "words", "n", "bins"]
    whole = F.lit(-1).cast("long")
    small = rows.where(F.col("all") <= BLOCK).select(F.pmod(F.xxhash64("key"), F.lit(deals)).alias("deal"), whole.alias("i"), whole.alias("j"), F.lit(2).alias("side"), *more)
    large = (
        rows.where(F.col("all") > BLOCK)
        .withColumn("own", F.pmod(F.xxhash64("node"), nb))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
        .select(F.col("key").alias("deal"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), *more)
    )
    return small.unionByName(large).groupBy("deal", "i", "j").applyInArrow(run, "a long, b long, n long")


def links(docs: DataFrame, text: str = "text", edits: int = EDITS) -> DataFrame:
    """(a, b, n): with b, links that connect all different like lines, as few as connect a block's;
    without b, rows whose sum of n is the number of like lines of node a. Every pair of like lines is
    found and counted, and none is a row of its own."""
    chars = docs.agg(F.sum(F.length(f"`{text}`"))).first()[0] or 0
    buckets = max(1, -(-int(chars) // BUCKET_CHARS))
    met = written(_met(_entries(docs, text, edits, buckets)), "met")
    texts = written(_texts(docs, text, met.select("node").distinct()), "texts")
    return written(_linked(met, texts, edits), "links")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """A row per line with a word: `id`, body, line (from 0), chars, class_id and class_line (the first
    line of its class, by id, then number), copies (equal lines) and n_links (different like lines).

    Lines are split at \\n and compared as they are. Lines of under `CHARS_PER_EDIT` characters allow no
    edit and are of one class with equal lines. Null and empty texts have no line; null ids come after
    others. Rows that share an id have their lines each, told apart by body, a hash of the text; equal
    rows stay equal. An id column of the name of another column here is named id_.
    """
    rows = written(occurrences(docs, id, text), "lines")
    linked = links(docs, text, edits)
    roots = components(linked.where("b is not null").select("a", "b"))
    degree = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "line", "body"))
    nodes = rows.groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"))
    nodes = nodes.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes, "nodes")
    # Nodes that nothing is like are their own class: only linked ones are grouped.
    many = nodes.where("n_links > 0").groupBy("root").agg(F.min("first").alias("lead"))
    nodes = nodes.join(many, "root", "left").select("node", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("lead", "first").alias("lead"))
    out = rows.join(nodes, "node")
    others = ["body", "line", "chars", "class_id", "class_line", "class_body", "copies", "n_links"]
    name = f"{id}_" if id.lower() in others else id
    return out.select(F.col("id").alias(name), "body", "line", "chars", F.col("lead.id").alias("class_id"), F.col("lead.line").alias("class_line"), F.col("lead.body").alias("class_body"), "copies", "n_links")


def _with_texts(pairs: DataFrame, texts: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the value of a as x and of b as y. Many a may meet one b: its value is sent
    to up to `PARTS` parts of its pairs."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    of_b = dealt.select("b", "part").distinct().join(texts.select(F.col("body").alias("b"), F.col(value).alias("y")), "b")
    return dealt.join(of_b, ["b", "part"]).drop("part").join(texts.select(F.col("body").alias("a"), F.col(value).alias("x")), "a")


def _near(both: DataFrame, similarity: float, want: bool = True) -> DataFrame:
    """The pairs (a, b) whose texts x and y are near-copies by words, or those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                hashes, sizes = word_hashes([*some.column("x").to_pylist(), *some.column("y").to_pylist()])
                words = np.split(hashes.astype("<u4"), np.cumsum(sizes)[:-1])
                good += [alike(x, y, similarity) == want for x, y in zip(words[: some.num_rows], words[some.num_rows :], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _copies(docs: DataFrame, rows: DataFrame, repeats: DataFrame, id: str, text: str, similarity: float) -> DataFrame:
    """(a, b) of bodies: a repeats lines that come first in b, and is a near-copy of b, both before
    and after the lines that repeat others have gone from the two."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sizes = docs.select(F.xxhash64(t).alias("body"), F.size(words(t)).alias("n")).groupBy("body").agg(F.max("n").alias("n"))
    met = repeats.where("body <> class_body").select(F.col("body").alias("a"), F.col("class_body").alias("b")).distinct()
    met = written(_with_texts(met, sizes, "n").where(F.greatest("x", "y") - F.least("x", "y") <= (1 - similarity) * F.greatest("x", "y") + 1e-9).select("a", "b"), "met")
    wanted = met.select(F.col("a").alias("body")).union(met.select("b")).distinct()
    holder = rows.groupBy("body").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("one")).join(wanted, "body").select(F.col("body").alias("of"), F.col("one.id").alias("by"))
    held = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(t).alias("body"), t.alias("text"))
    texts = held.join(holder, F.col("id").eqNullSafe(F.col("by")) & (F.col("body") == F.col("of"))).groupBy("body").agg(F.any_value("text").alias("text"))
    texts = written(texts, "texts")
    near = written(_near(_with_texts(met, texts, "text"), similarity), "near")
    lines = repeats.join(wanted, "body", "semi").select("body", "line", "again", "class_body").distinct()
    lines = written(lines, "lines")
    while True:  # every round takes pairs away
        gone = _going(lines, near).groupBy("body").agg(F.collect_set("line").alias("gone"))
        now = texts.join(gone, "body", "left").select("body", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"), F.col("gone").isNotNull().alias("cut"))
        both = _with_texts(near, now.withColumn("value", F.struct("text", "cut")), "value").where("x.cut or y.cut")
        apart = written(_near(both.select("a", "b", F.col("x.text").alias("x"), F.col("y.text").alias("y")), similarity, False), "apart")
        if apart.isEmpty():
            return near
        near = written(near.join(apart, ["a", "b"], "anti"), "near")


def _going(repeats: DataFrame, near: DataFrame) -> DataFrame:
    """The repeats that go: those of a line of the same text, and those of a text that is no near-copy."""
    pairs = near.select(F.col("a").alias("body"), F.col("b").alias("class_body"), F.lit(True).alias("copy"))
    return repeats.join(pairs, ["body", "class_body"], "left").where(F.col("again") | ((F.col("body") != F.col("class_body")) & F.col("copy").isNull()))


def _without(text: Column, gone: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", similarity: float = SIMILARITY, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """The documents, in their own columns, without lines that repeat a line met before.

    Of each class of like lines the first stays, whatever share of a text the others are. Only the
    lines that a text shares with a near-copy where they come first stay too, as the two are copies
    of documents rather than of lines: their words, all in order, have the similarity at which
    `nearcopies` takes one of them. Lines of under `least` characters stay. No row is added or
    dropped; a text of nothing but repeats is left empty.
    """
    of, of_body, gone_lines = fresh(docs, "gone_id", "gone_body", "gone")
    found = classes(docs, id, text, edits)
    # Equal rows are one here, so that what is grouped by text below is a text's lines at most.
    rows = written(found.withColumnRenamed(found.columns[0], "id").distinct(), "classes")
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("line") == F.col("class_line")) & (F.col("body") == F.col("class_body"))
    own = Window.partitionBy("id", "body", "class_id", "class_line", "class_body")
    again = F.when(F.col("body") == F.col("class_body"), F.col("line") != F.col("class_line")).otherwise(F.col("line") > F.min("line").over(own))
    repeats = written(rows.where(~first & (F.col("chars") >= least)).withColumn("again", again).select("id", "body", "line", "again", "class_body"), "repeats")
    near = _copies(docs, rows, repeats, id, text, similarity)
    gone = _going(repeats, near).groupBy(F.col("id").alias(of), F.col("body").alias(of_body)).agg(F.collect_set("line").alias(gone_lines))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.join(gone, F.col(f"`{id}`").eqNullSafe(F.col(of)) & (F.xxhash64(t) == F.col(of_body)), "left")
    same = F.col(gone_lines).isNull()
    body = F.when(same, F.col(f"`{text}`")).otherwise(_without(t, F.col(gone_lines)))
    new = {text: body}
    if n_chars in docs.columns:
        new[n_chars] = F.when(same, F.col(f"`{n_chars}`")).otherwise(F.length(body)).cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
