"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition is encoded and written as
one shard file in the shared folder, then read back with Spark's binary reader. A shard is

    blocks   of documents in key order, each compressed: keys by shared prefix with the key before
    index    the first key, place and size of each block (sparse: one entry a block)
    filter   a Bloom filter of all keys
    footer   40 bytes: places of index and filter, counts, width of an id, magic

so that a key is found by the filter, a binary search of the index, and one block. A key is eight
bytes that sort as the signed identifier does, after a byte that puts null identifiers first.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Characters of text to a shard, ids' bytes to a block, bits of the filter to a key, its hashes.
SHARD_CHARS, BLOCK_BYTES, BITS, PROBES = 24_000_000, 1 << 17, 10, 7
FOOTER, FOOTER_BYTES, MAGIC = "<QQQQHxx4s", 40, b"LSS1"
#: Items of words whose ids a task keeps at hand, beyond which it starts over; bytes of text encoded at once.
KNOWN_ITEMS, AT_ONCE = 600_000, 8_000_000
#: How the tokenizers of the word-wise kind cut texts, and the words that are cut here: letters
#: that composing leaves alone (not the one whose lower case has a mark of its own) and digits, then signs. Not
#: the apostrophe, which those tokenizers join with letters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = r"""^(?P<stem>[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+)(?P<rest>[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)$"""
MANIFEST = "shard int, file string, low long, high long, docs long, tokens long"


class Encoder:
    """Texts to their ids, many texts at a time, for any tokenizer file.

    A text is cut at blanks and line breaks, across which no tokenizer of the kind that `by_words`
    admits joins or orders characters. Equal words are found by Arrow's dictionary encoding, so Python
    sees a word once a batch. A word of Latin letters and digits with ASCII signs behind it is two
    items, as such a tokenizer ends a token between a letter and a sign; any other word is one item.
    Items not met before go to the tokenizer as a list that is cut already: it then says of every id
    which item it is of, whatever its normaliser makes of the letters. Texts are their items' ids, put
    together by index. A text that itself holds special tokens is encoded whole, as is every text for
    a tokenizer of another kind.
    """

    def __init__(self, path: str, end: int | None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tail = np.array([] if end is None else [end], self.kind)
        with open(path) as f:
            self.by_words = by_words(json.load(f))
        self.forget()

    def forget(self) -> None:
        self.items: dict[str, int] = {"": 0}
        self.ids, self.starts, self.held = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, new: list[str]) -> None:
        """Gives each new item a number and keeps its ids."""
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part)), "right")
            first = len(self.items)
            while first + len(part) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            while self.held + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.held : self.held + len(ids)] = ids
            # starts[k] is where item k begins; item 0, the empty one, has no ids.
            self.starts[first + 1 : first + 1 + len(part)] = self.held + ends
            self.held += len(ids)
            self.items.update(zip(part, range(first, first + len(part)), strict=True))

    def numbers(self, words: pa.Array) -> np.ndarray:
        found = words.dictionary_encode()
        names = found.dictionary.to_pylist()
        new = [x for x in names if x not in self.items]
        if new:
            self.learn(new)
        return np.fromiter(map(self.items.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's end id included, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            parts = [np.concatenate([self.whole(t), self.tail]) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.kind), *parts]), np.array([len(x) for x in parts], np.int64)
        odd = np.zeros(len(texts), bool)
        for x in self.special:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd)
        if len(self.items) > KNOWN_ITEMS:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        cut = pc.extract_regex(words.dictionary, CUT)
        plain = cut.is_valid()
        first = self.numbers(pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, "stem")), words.dictionary))
        rest = self.numbers(pc.if_else(plain, pc.struct_field(cut, "rest"), pa.scalar("", pa.large_string())))
        # Each word is two items; each text ends with one more, for the end id.
        at = words.indices.to_numpy()
        ends = 2 * (lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]) + np.arange(len(texts))
        last = np.zeros(2 * len(at) + len(texts), bool)
        last[ends] = True
        item = np.zeros(len(last), np.int64)
        item[~last] = np.stack([first[at], rest[at]], axis=1).ravel()
        sizes = self.starts[item + 1] - self.starts[item]
        sizes[last] = len(self.tail)
        stop = np.cumsum(sizes)
        ids = self.ids[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.starts[item] - (stop - sizes), sizes)]
        if len(self.tail):
            ids[stop[ends] - 1] = self.tail[0]
        return ids, np.diff(stop[ends], prepend=0)

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.encode(texts.filter(pa.array(~odd)))
        parts = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        out = [np.concatenate([self.whole(t.as_py()), self.tail]) if o else next(parts) for t, o in zip(texts, odd, strict=True)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def values(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, worked out for a bounded number of characters at once."""
        for some in _slices(texts):
            ids, sizes = self.encode(some)
            yield from np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def sizes(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[self.encode(some)[1] for some in _slices(texts)]])


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file's steps are those that the word-wise way rests on: characters composed,
    white space made blanks, letters lower-cased, tokens cut where letters, digits and signs meet."""
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    plain = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ") for x in steps)
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    cut = len(cuts) == 2 and cuts[0].get("type") == "Split" and cuts[0].get("pattern") == {"Regex": SPLIT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space")
    lower = any(x.get("type") == "Lowercase" for x in steps)
    return bool(plain and lower and cut and not spec.get("post_processor") and not (spec.get("model") or {}).get("dropout"))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0
    ends = np.cumsum(sizes)
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        yield texts.slice(at, end - at)
        at = end


def key_of(id: int | None) -> bytes:
    return b"\0" if id is None else b"\1" + struct.pack(">Q", id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Takes (key, value) in key order and gives the bytes of one shard. Values of a block are kept
    packed, so a shard in memory is about as large as its file."""

    def __init__(self, width: int):
        self.width, self.parts, self.index, self.keys = width, [], [], []
        self.at = self.tokens = self.held = 0
        self.block: list[tuple[bytes, bytes]] = []

    def add(self, key: bytes, value: bytes) -> None:
        self.block.append((key, value))
        self.keys.append(key)
        self.held += len(value)
        self.tokens += len(value) // self.width
        if self.held >= BLOCK_BYTES:
            self.close()

    def close(self) -> None:
        if not self.block:
            return
        heads, last = [struct.pack("<I", len(self.block))], b""
        for key, value in self.block:
            same = 0
            while same < min(len(key), len(last)) and key[same] == last[same]:
                same += 1
            heads.append(struct.pack("<BBI", same, len(key) - same, len(value)) + key[same:])
            last = key
        raw = b"".join(heads + [v for _, v in self.block])
        data = pa.compress(raw, codec="zstd", asbytes=True)
        first = self.block[0][0]
        self.index.append(struct.pack("<B", len(first)) + first + struct.pack("<QII", self.at, len(data), len(raw)))
        self.parts.append(data)
        self.at += len(data)
        self.block, self.held = [], 0

    def done(self) -> bytes:
        self.close()
        bits = max(64, len(self.keys) * BITS)
        filter = np.zeros(bits, np.uint8)
        for key in self.keys:
            filter[_probes(key, bits)] = 1
        index = b"".join(self.index)
        foot = struct.pack(FOOTER, self.at, self.at + len(index), len(self.keys), self.tokens, self.width, MAGIC)
        return b"".join([*self.parts, index, struct.pack("<I", bits), np.packbits(filter).tobytes(), foot])


class Reader:
    """A shard by its bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        index, filter, self.docs, self.tokens, self.width, magic = struct.unpack(FOOTER, self.data[-FOOTER_BYTES:])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bits = struct.unpack("<I", self.data[filter : filter + 4])[0]
        self.filter = self.data[filter + 4 : -FOOTER_BYTES]
        self.firsts, self.places, at = [], [], index
        while at < filter:
            n = self.data[at]
            self.firsts.append(bytes(self.data[at + 1 : at + 1 + n]))
            self.places.append(struct.unpack("<QII", self.data[at + 1 + n : at + 17 + n]))
            at += 17 + n

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        start, size, raw_size = self.places[k]
        raw = pa.decompress(self.data[start : start + size], raw_size, codec="zstd", asbytes=True)
        n, at, key, heads = struct.unpack("<I", raw[:4])[0], 4, b"", []
        for _ in range(n):
            same, rest, length = struct.unpack("<BBI", raw[at : at + 6])
            key = key[:same] + raw[at + 6 : at + 6 + rest]
            heads.append((key, length))
            at += 6 + rest
        for key, length in heads:
            yield key, raw[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def find(self, key: bytes) -> list[bytes]:
        """The values of a key: all of them where documents share it."""
        if not all(self.filter[i >> 3] & (128 >> (i & 7)) for i in _probes(key, self.bits)):
            return []
        k, out = bisect_right(self.firsts, key) - 1, []
        while k > 0 and self.firsts[k] == key:
            k -= 1
        while 0 <= k < len(self.firsts) and self.firsts[k] <= key:
            out += [v for x, v in self.block(k) if x == key]
            k += 1
        return out


def put(url: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so a lost or repeated task leaves no part."""
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def write(docs: DataFrame, tokenizer: str, where: str | None = None, id: str = "doc_id", text: str = "text", end: int | None = 2, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Writes the documents' shards and gives their manifest, itself a table at `where`/manifest.

    Null texts have the end id alone. Documents are in the order of their ids, null ids first; those
    that share an id are all kept, side by side in the order of a hash of their texts, and may take
    up several shards. An empty table gives an empty manifest.
    A task that is run again writes the same bytes under the same name.
    """
    spark = docs.sparkSession
    where = where or shared_dir(spark, "shards")
    chars = docs.agg(F.sum(F.length(f"`{text}`") + 1)).first()[0] or 0
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, -(-int(chars) // shard_chars)), "id", "body").sortWithinPartitions("id", "body", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(tokenizer, end)
        out, low, high = Writer(encoder.kind.itemsize), None, None
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, value in zip(ids, encoder.values(batch.column("text")), strict=True):
                out.add(key_of(i), value.tobytes())
                low, high = i if low is None else low, i
        if out.keys:
            shard = TaskContext.get().partitionId()
            file = f"shard-{shard:06d}.lss"
            put(f"{where}/{file}", out.done())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "docs": [len(out.keys)], "tokens": [out.tokens]})

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{where}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{where}/manifest").withColumn("where", F.lit(where))


def read(spark: SparkSession, where: str, with_ids: bool = True) -> DataFrame:
    """What the files hold, a row per document: id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked, the ids."""
    from pyspark.sql import Window

    manifest = spark.read.schema(MANIFEST).parquet(f"{where}/manifest")
    # One row a shard: a window over all of them is the size of the manifest, not of the data.
    base = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    manifest = manifest.select("file", F.coalesce(base, F.lit(0)).alias("base"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                shard, start = Reader(data.as_buffer()), 0
                file = path.as_py().rpartition("/")[2]
                for k in range(len(shard.places)):
                    i, s, n, c, v = [], [], [], [], []
                    for key, value in shard.block(k):
                        ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        i.append(id_of(key))
                        s.append(start)
                        n.append(len(ids))
                        c.append(zlib.crc32(ids))
                        v.append(ids if with_ids else None)
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(i), pa.string()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.list_(pa.int32()))], names=["file", "id", "local", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lss").load(where).select("path", "content")
    rows = files.mapInArrow(parse, "file string, id long, local long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows.join(manifest, "file").select("id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, where: str, ids: list[int]) -> DataFrame:
    """The documents of some identifiers: (id, ids), by filter and binary search in the shards whose
    range may hold them. Identifiers that no document has give no row."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{where}/manifest")
    wanted = sorted(set(ids))
    hit = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda x: ((F.col("low").isNull()) | (F.col("low") <= x)) & (F.col("high") >= x))
    files = [f"{where}/{r.file}" for r in manifest.where(hit).select("file").collect()] if wanted else []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                shard = Reader(data.as_buffer())
                for i in wanted:
                    for value in shard.find(key_of(i)):
                        yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "ids": pa.array([np.frombuffer(value, f"<u{shard.width}").astype(np.int32)], pa.list_(pa.int32()))})

    schema = "id long, ids array<int>"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(find, schema)
