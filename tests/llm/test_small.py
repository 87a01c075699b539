"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import components, decontam, editing, langmodel, licenses, lines, nearcopies, packing, quality, shards, toxicity, urls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omicron sigma upsilon omega north south east west river".split()


def prose(seed, n, ends=9):
    out, x = [], seed
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 7) + ("." if i % ends == ends - 1 or i == n - 1 else ""))
    return " ".join(out)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, blank and long texts, and columns whose names clash."""
    rows = [(None, prose(1, 40)), (1, None), (2, ""), (3, " \t\n "), (4, prose(2, 30_000)), (5, prose(3, 50)), (5, prose(3, 50)), (5, prose(4, 50)), (6, "x" * 50_000), (7, "éa " * 30 + "."), (8, prose(5, 60))]
    frame = docs(spark, rows)
    for name in ("node", "QUALITY", "line", "gone", "kept_id", "leaked_id", "id", "h", "judged", "body", "start", "class_id", "shard", "part"):
        frame = frame.withColumn(name, F.lit(7))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = "item_id bigint, text string"


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "decontamination"], ids=lambda s: s[0])
def test_stages_take_odd_and_empty_tables(spark, odd, stage):
    name, f = stage
    out = f(spark, odd, "")
    if name != "best_fit_packing":
        assert out.columns == odd.columns
    assert out.count() > 0
    assert f(spark, empty(spark), "").count() == 0


def test_decontamination_takes_rows_by_themselves(spark):
    """A leaking row draws along no clean one of its id, nor the rows that have no id as it has none."""
    leak, clean = prose(5, 60), [prose(20 + i, 50) for i in range(4)]
    rows = [(1, leak), (1, clean[0]), (None, leak), (None, clean[1]), (None, None), (2, clean[2]), (2, clean[2]), (3, f"{clean[3]} {leak}"), (3, clean[3])]
    out = decontam.without(docs(spark, rows).withColumn("own_key", F.lit(1)), spark.createDataFrame([(9, leak)], BENCH))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, clean[0]), (0, clean[1]), (0, ""), (2, clean[2]), (2, clean[2]), (3, clean[3])])


@pytest.mark.parametrize("name", ["score", "class_id", "n_words", "SCORE", "id"])
def test_an_id_named_like_a_result(spark, name):
    rows = docs(spark, [(1, prose(1, 30)), (2, prose(1, 30)), (None, None)]).withColumnRenamed("doc_id", name)
    every = [nearcopies.classes(rows, id=name), langmodel.fit_and_score(rows, F.lit(True), id=name)[0], toxicity.scored(rows, {"weights": {"alpha": 1.0}, "bias": -2.0}, id=name)]
    for out in every:
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.columns[0] == name
        assert sorted((r[name] is None, r[name] or 0) for r in out.select(f"`{name}`").collect()) == [(False, 1), (False, 2), (True, 0)]


def test_decontamination_takes_odd_tables(spark, odd):
    bench = spark.createDataFrame([(1, prose(5, 60)), (2, None), (3, ""), (4, "two words"), (5, prose(5, 60))], BENCH)
    out = decontam.without(odd, bench)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in odd.select("doc_id").exceptAll(out.select("doc_id")).collect()) == [8]
    assert decontam.without(empty(spark), bench).count() == 0
    assert decontam.without(odd, spark.createDataFrame([], BENCH)).count() == odd.count()


def test_scores_of_odd_rows(spark, odd):
    out, model = langmodel.fit_and_score(odd, F.col("doc_id").isNotNull())
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [1]
    assert langmodel.fit_and_score(empty(spark), F.lit(True))[0].count() == 0
    nobody, _ = langmodel.fit_and_score(odd, F.lit(False))
    assert all(r.n_known == 0 for r in nobody.collect())


def test_scores_by_brute_force(spark):
    rows = [(i, prose(i % 9, 30 + i)) for i in range(40)]
    out, model = langmodel.fit_and_score(docs(spark, rows), F.col("doc_id") % 4 != 0)
    text = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in rows}
    train = [["<s>", *w, "</s>"] for i, w in text.items() if i % 4 != 0]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(c for w, c in uni.items() if w != "<s>"), len(uni) - 1
    assert (model.tokens, model.types) == (n, v)
    for r in out.collect():
        t = ["<s>", *text[r.doc_id], "</s>"]
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t[1:])
        total = 0.0
        for h, w in zip(t, t[1:]):
            level = 2 if uni[h] else 1
            key = level * 64 + (int(math.log2(uni[h])) + 1 if level == 2 else 0)
            weights = model.weights.get(key, [1 / (level + 1)] * (level + 1))
            p = weights[0] / (v + 1) + weights[1] * uni[w] / n + (weights[2] * bi[h, w] / uni[h] if level == 2 else 0)
            total += math.log10(p)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(total, rel=1e-9)


def test_shards_round_trip(spark, odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    more = docs(spark, [(-3, "Don't I'll x's BAR!! a1b2 3.14 İstanbul ΣΑΣ. naïve “q” <x>\x0b\x1cy"), (9, "a<|endoftext|>b")])
    frame = odd.select("doc_id", "text").union(more.select("doc_id", "text"))
    where = shards.shared_dir(spark, "test")
    shards.write(frame, path, where, shard_chars=60_000)
    got = sorted(((r.start, r.id, r.n_tokens, r.ids_crc32, r.ids) for r in shards.read(spark, where).collect()), key=lambda r: r[0])
    want, start = [], 0
    for i, t, _ in sorted(frame.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((start, i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)), ids))
        start += len(ids)
    assert got == want
    found = shards.lookup(spark, where, [5, 8, 12345, -3]).collect()
    assert Counter(r.id for r in found) == {5: 3, 8: 1, -3: 1}
    assert shards.write(empty(spark), path).count() == 0


def test_every_letter_alone_and_between_words():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(1, sys.maxunicode)) if c.isalpha() and not 0x3400 < ord(c) < 0x9FFF and not 0xAC00 < ord(c) < 0xD7A0 and ord(c) < 0x17000]
    texts = [f"one two {c} three{c}, {c}four five!{c}" for c in letters]
    texts += ["ab \u0958 cd ef", "north \u0958x, south", "x\ufb2a. east", "a\u0301?! \u0301b", "q'' don't!! it's?", "1st2 \u00b2x \u2460.", "a\tb\u00a0c\x1cd", " ".join(letters[:3000])]
    encoder = shards.Encoder(path, None)
    assert encoder.by_words
    for _ in range(2):  # the second time all words are known
        got = [v.tolist() for v in encoder.values(pa.array(texts))]
        bad = [t for t, g in zip(texts, got) if g != tok.encode(t, add_special_tokens=False).ids]
        assert bad == []
    plain = [f"plain{chr(97 + k % 26)}{chr(97 + k // 26)} words" for k in range(300)]
    assert [v.tolist() for v in encoder.values(pa.array(plain))] == [tok.encode(t, add_special_tokens=False).ids for t in plain]


def test_other_tokenizers_encode_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    assert shards.by_words(spec)
    assert not shards.by_words({**spec, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}})
    assert not shards.by_words({**spec, "normalizer": {"type": "NFKC"}})


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


@pytest.mark.parametrize("path", [None, "word_bpe_49k.json"])
def test_packing_places_every_token_once(spark, odd, path):
    sizes, count = (64, 256, 1024), _words
    if path:
        public_tokenizers = pytest.importorskip("public_tokenizers")
        from tokenizers import Tokenizer

        path = public_tokenizers.path(path)
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    rows = packing.packed(odd, path, sizes=sizes, shard=10).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        at = 0
        for r in held:
            assert r.offset == at
            at += r.n_tokens
        assert at == held[0].filled <= held[0].capacity and held[0].capacity == min(s for s in sizes if s >= at)
    assert sum(r.n_tokens for r in rows) == sum(count(r.text) for r in odd.select("text").collect())


def test_sequences_hold_the_ids_of_the_shards(spark, odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    where = shards.shared_dir(spark, "test")
    shards.write(odd, path, where)
    want = Counter((r.id, tuple(r.ids)) for r in shards.read(spark, where).collect())
    parts = {}
    for r in packing.sequences(odd.select("doc_id", "text"), path, sizes=(256, 1024), shard=10).collect():
        assert len(r.ids) <= r.capacity and sum(d.n_tokens for d in r.docs) == len(r.ids)
        for d in r.docs:
            parts.setdefault((d.id, d.piece), []).append(tuple(r.ids[d.offset : d.offset + d.n_tokens]))
    assert sum(map(len, parts.values())) == sum(-(-len(ids) // 1024) * n for (_, ids), n in want.items())
    assert Counter({(i, ids): n for (i, ids), n in want.items() if len(ids) <= 1024}) == Counter((i, ids) for (i, p), some in parts.items() for ids in some if len(ids) < 1024 and p == 0)
    long = next(ids for (i, ids) in want if i == 4)
    assert sum((parts[4, p][0] for p in range(-(-len(long) // 1024))), ()) == long


def test_packing_of_clashing_ids(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "shard long, text string")
    assert packing.packed(frame, id="shard").columns[0] == "shard_"
    assert packing.packed(frame, id="shard").count() == 3


def test_best_fit_by_brute_force():
    lengths, sizes = sorted([(i * 37) % 97 + 1 for i in range(200)], reverse=True), (64, 128)
    room, out = [], []
    for k, n in enumerate(lengths):
        fit = [(space, b) for b, space in enumerate(room) if space >= n]
        if fit:
            _, b = min(fit)
        else:
            def cost(c):
                return (c + packing.OPENING) / max(1, n + min(c - n, sum(x for x in lengths[k + 1 :] if x <= c - n))), -c

            b = len(room)
            room.append(min((c for c in sizes if c >= n), key=cost))
        out.append(b)
        room[b] -= n
    assert [b for b, _ in packing.best_fit(lengths, sizes)] == out
    assert packing.best_fit([], sizes) == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_by_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choice("abc") for _ in range(rng.randrange(3)))
        most = rng.randrange(6)
        assert editing.edit_distance(a, b, most) == min(distance(a, b), most + 1)
        assert editing.edit_distance(list(a), list(b), most) == min(distance(a, b), most + 1)


def like(a, b):
    return a != b and distance(a, b) <= min(lines.EDITS, min(len(a), len(b)) // lines.CHARS_PER_EDIT)


def test_line_links_by_brute_force(spark):
    base = [prose(k, 4, 99) for k in range(30)]
    more = [b[:5] + "q" + b[6:] for b in base[:10]] + [b[:-2] for b in base[5:12]] + ["z" + b + "z" for b in base[3:9]] + base[:4]
    more += [w + x for w in ("onetwo78", "onetwo8", "fifteen chars 5", "fifteen chars 56", "no", "sevench") for x in ("", "1", "2", "ab")]
    more += ["\u00a0" * 9, "\u00a0" * 10, "bad" * 3, "bid" * 3]
    rows = [(i, "\n".join([x, "short", x.upper(), " \t"])) for i, x in enumerate(base + more)]
    texts = sorted({x for _, t in rows for x in t.split("\n") if x.strip(lines.BLANK)})
    want = {x: sum(like(x, y) for y in texts) for x in texts}
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(texts):
        for y in texts[k + 1 :]:
            if like(x, y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    frame = docs(spark, rows)
    name = {r.n: r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("n"), "t").collect()}
    found = lines.classes(frame).collect()
    line = {(r.doc_id, r.line): rows[r.doc_id][1].split("\n")[r.line] for r in found}
    assert len(found) == 3 * len(rows)
    for block, deal in ((lines.BLOCK, lines.DEAL), (2, 1)):  # blocks of two: every pair of a group must still meet, once
        saved = lines.BLOCK, lines.DEAL
        try:
            lines.BLOCK, lines.DEAL = block, deal
            got = Counter()
            for r in lines.links(frame).collect():
                got[name[r.a]] += r.n
                assert r.b is None or find(name[r.a]) == find(name[r.b])
            assert {x: n for x, n in got.items() if n} == {x: n for x, n in want.items() if n}
        finally:
            lines.BLOCK, lines.DEAL = saved
    by_class = {}
    for r in found:
        assert r.n_links == want[line[r.doc_id, r.line]]
        by_class.setdefault((r.class_id, r.class_line), set()).add(find(line[r.doc_id, r.line]))
    assert all(len(x) == 1 for x in by_class.values()) and len(by_class) == len({find(x) for x in texts})
    assert all(r.copies == len(rows) and r.n_links == 0 for r in found if r.chars == 5)


def test_lines_of_clashing_ids(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e g")], "line long, text string")
    got = lines.classes(frame, id="line")
    assert got.columns[:3] == ["line_", "body", "line"]
    assert sorted((r.line_ or 0, r.class_id, r.copies, r.n_links) for r in got.collect()) == [(0, 1, 1, 1), (1, 1, 2, 1), (1, 1, 2, 1)]


def test_repeated_lines_go_but_copies_of_documents_stay(spark):
    common = prose(77, 20)
    rows = [(i, prose(i, 60) + "\n" + common + "\n" + prose(100 + i, 60)) for i in range(5)]
    rows += [(10, prose(0, 60) + "\n" + prose(50, 30) + "\n" + prose(100, 60))]  # shares two lines with 0
    out = {r.doc_id: r.text for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert common in out[0] and all(common not in out[i] for i in range(1, 5))
    assert out[10] == rows[-1][1]


@pytest.mark.parametrize("share", [20, 50, 79])
def test_repeats_go_whatever_their_share(spark, share):
    passage = prose(900, share) + "\n" + prose(901, share)
    rows = [(0, prose(0, 300) + "\n" + passage), (1, passage + "\n" + prose(1, 200 - 2 * share))]
    rows += [(2, "\n".join(prose(k, 300) if k == 0 else prose(50 + k, 100) for k in range(4))), *((10 + k, prose(50 + k, 100)) for k in range(1, 4))]
    rows += [(20, "\n".join([prose(70, 30)] * 9)), (30, "\n".join(prose(80 + k, 30) for k in range(10))), (31, "\n".join(prose(80 + k + (k > 7) * 20, 30) for k in range(10)))]
    out = {r.doc_id: r.text for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert out[0] == rows[0][1] and out[1] == prose(1, 200 - 2 * share)
    assert out[2] == "\n".join(prose(50 + k, 100) for k in range(1, 4)) and [out[10 + k] for k in range(1, 4)] == ["", "", ""]
    assert out[20] == prose(70, 30)
    assert out[31] == rows[-1][1]  # a near-copy of 30, at 0.8


def test_pieces_of_many_documents_go(spark):
    rows = [(k, prose(k, 100) + "\n" + prose(50 + k, 40)) for k in range(6)]
    rows += [(9, "\n".join(prose(50 + k, 40) for k in range(6)) + "\n" + prose(99, 10))]
    out = {r.doc_id: r.text for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert out == {**dict(rows[:6]), 9: prose(99, 10)}


def test_near_copies_by_brute_force(spark):
    rows = []
    for k in range(12):
        text = prose(k, 120)
        rows.append((10 * k, text))
        for j in range(1, 4):
            words = text.split()
            for e in range(j * (k % 4) * 3):
                words[(e * 17 + j) % len(words)] = f"changed{e}"
            rows.append((10 * k + j, " ".join(words)))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "ONE  two")]
    ids = [i for i, _ in rows]
    words = {i: (t or "").lower().split() for i, t in rows}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            longest = max(len(words[a]), len(words[b]))
            if distance(words[a], words[b]) <= (1 - nearcopies.SIMILARITY) * longest + 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in nearcopies.classes(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in ids}
    saved = nearcopies.BLOCK
    try:
        nearcopies.BLOCK = 2
        assert {r.doc_id: r.class_id for r in nearcopies.classes(docs(spark, rows)).collect()} == got
    finally:
        nearcopies.BLOCK = saved
    kept = sorted(r.doc_id for r in nearcopies.one_of_each(docs(spark, rows)).collect())
    assert kept == sorted(set(got.values()))


def test_one_of_each_by_row_not_by_id(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(3, b), (5, a), (5, b), (7, a), (None, c), (None, c), (None, a), (8, None), (9, ""), (9, "")]
    got = Counter((r.doc_id, r.text) for r in nearcopies.one_of_each(docs(spark, rows)).collect())
    assert got == Counter([(3, b), (5, a), (None, c), (8, None)])
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in nearcopies.classes(docs(spark, rows)).collect())
    assert got == Counter({(3, 3, 2): 1, (5, 5, 3): 1, (5, 3, 2): 1, (7, 5, 3): 1, (None, 5, 3): 1, (None, None, 2): 2, (8, 8, 3): 1, (9, 8, 3): 2})


@pytest.mark.parametrize(("similarity", "spread", "least"), [(0.95, "random", 0.99), (0.95, "even", 0.99), (0.9, "random", 0.99), (0.9, "even", 0.99), (0.85, "random", 0.97), (nearcopies.SIMILARITY, "random", 0.9)])
def test_recall_of_sketches(similarity, spread, least):
    import random

    from lodestone.llm.hashing import word_hashes

    rng, texts = random.Random(11), []
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        edits = round(300 * (1 - similarity))
        at = rng.sample(range(300), edits) if spread == "random" else [i * 300 // edits for i in range(edits)]
        other = [f"x{rng.randrange(10**6)}" if i in set(at) else w for i, w in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    sketches = nearcopies.order_sketches(*word_hashes(texts))
    shared = ((sketches[::2] == sketches[1::2]) & (sketches[1::2] != 0)).any(axis=1)
    assert shared.mean() >= least


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}


def test_overlaps_tolerate_substitutions_both_ways_of_joining(spark):
    item = prose(9, 30)
    words = item.split()
    words[6], words[15], words[24] = "other", "words", "here"
    rows = [(1, prose(1, 40) + " " + item + " " + prose(2, 40)), (2, prose(3, 20) + " " + " ".join(words)), (3, prose(4, 90)), (4, " ".join(words[:6]))]
    bench = spark.createDataFrame([(7, item), (8, item)], BENCH)
    for most in (10**6, 1):
        got = {(r.doc_id, r.item_id): r for r in decontam.overlaps(docs(spark, rows), bench, most_seeds=most).collect()}
        assert set(got) == {(1, 7), (2, 7)}
        assert (got[1, 7].doc_at, got[1, 7].matched, got[2, 7].matched) == (40, 30, 27)


def test_overlaps_with_long_items_and_ties(spark):
    long, short = " ".join(f"w{k * 7919 % 100_003}" for k in range(6_000)), prose(21, 30)
    rows = [(1, prose(5, 50) + " " + " ".join(long.split()[3000:3040])), (2, short + " x " + short), (None, " ".join(long.split()[-20:])), (4, short), (4, short)]
    bench = spark.createDataFrame([(1, long), (2, short), (3, "just six words are not enough"), (4, None)], BENCH)
    wanted = {(1, 1): (0, 40), (2, 2): (0, 30), (None, 1): (0, 20), (4, 2): (0, 30)}
    for most in (10**6, 1):
        got = decontam.overlaps(docs(spark, rows), bench, most_seeds=most).collect()
        assert {(r.doc_id, r.item_id): (r.doc_at, r.matched) for r in got} == wanted


def test_licenses_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "some words here\nnothing else"),
        (3, "a/b/LICENSE.txt", "# Licensed under the Apache License, Version 2.0."),
        (4, "a/b/y.py", "All rights reserved.\nmore"),
        (5, "z/y.py", "the under of"),
        (6, None, None),
        (7, "a/q.py", ""),
        (None, "a/b/c/d/n.py", "words"),
    ]
    out = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert out[1] == ("MIT", "own", "a") and out[7] == ("MIT", "inherited", "a")
    assert out[2] == out[None] == ("Apache-2.0", "inherited", "a/b")
    assert out[4] == ("Proprietary", "own", "a/b")
    assert out[5] == (None, "none", None) and out[6] == (None, "none", None)
    assert licenses.scanned(spark.createDataFrame([], "doc_id bigint, path string, text string")).count() == 0


def license_scores(texts):
    """By brute force: the best (minus score, kind, at, license) of each text."""
    held = {i: set(licenses.terms(t or "")) for i, t in texts.items()}
    weigh = lambda w: math.log((1 + len(texts)) / (1 + sum(w in h for h in held.values()))) + 1
    vector = lambda t: {w: c * weigh(w) for w, c in Counter(licenses.terms(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(body)) for name, bodies in licenses.TEMPLATES.items() for body in bodies]
    want = {}
    for i, t in texts.items():
        t = (t or "").lower()
        for kind, parts in enumerate((t.split("\n"), re.split(r"\n[^a-z0-9]*\n", t), [t])):
            for k, unit in enumerate(parts):
                v = vector(unit)
                for name, u in known if v else ():
                    score = round(sum(x * v.get(w, 0) for w, x in u.items()) / (size(u) * size(v)), 6)
                    if score >= licenses.THRESHOLD:
                        want[i] = min(want.get(i, (0, 0, 0, "")), (-score, kind, k, name))
    return want


def wrapped(text, width, mark):
    out, line = [], mark
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = mark
        line += " " + w
    return "\n".join([*out, line])


def test_licenses_by_brute_force(spark):
    common = "It is and the of to in on."
    notice = "Licensed under the Apache License, Version 2.0. " + common
    mit, gpl, apache = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["GPL-3.0"][-1], licenses.TEMPLATES["Apache-2.0"][-1]
    file = "MIT License\n\nCopyright (c) 2020 A. Name\n\n" + mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS", 1)
    texts = {0: notice, **{i: common + f" rare{i}" for i in range(1, 300)}, 400: None, 401: "nothing\nLicensed under the Apache License, Version 2.0. zig zag"}
    texts |= {500: wrapped(gpl, 70, "//") + "\n\n" + prose(1, 300), 501: wrapped(mit, 76, " *"), 502: file, 503: "#!/bin/sh\n#\n" + wrapped(apache, 72, "#") + "\n#\n" + prose(2, 200)}
    texts |= {504: "# SPDX-License-Identifier: Apache-2.0\n" + prose(3, 50), 505: "SPDX-License-Identifier: Unheard-Of-9", 506: prose(4, 20_000) + "\nAll rights reserved.", 507: "permission to use the license", 508: "x" * 50_000}
    want = license_scores(texts)
    rows = [(i, t) for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    body = {r.doc_id: r.b for r in frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    got = {r.body: r for r in licenses.matched(frame).collect()}
    assert set(got) == {body[i] for i in want}
    for i, (minus, kind, at, name) in want.items():
        r = got[body[i]]
        assert (r.license, r.unit, r.at) == (name, licenses.UNITS[kind], at) and r.score == pytest.approx(-minus, abs=2e-6)
    assert {i: want[i][3] for i in (0, 500, 501, 502, 503, 504, 506)} == {0: "Apache-2.0", 500: "GPL-3.0", 501: "MIT", 502: "MIT", 503: "Apache-2.0", 504: "Apache-2.0", 506: "Proprietary"}
    assert 505 not in want and 507 not in want


def test_licenses_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a/x", "Released under the MIT License."), (1, "a/x", "Released under the MIT License."), (1, "b/y", "words under the license"), (None, "a/LICENSE", "Released under the MIT License.")]
    frame = spark.createDataFrame(rows, "score bigint, path string, text string").withColumn("body", F.lit(1)).withColumn("license", F.lit("none"))
    got = licenses.scanned(frame, id="score").collect()
    assert Counter((r.score_, r.license, r.score, r.origin) for r in got) == Counter({(1, "MIT", 1.0, "own"): 2, (1, None, None, "none"): 1, (None, "MIT", 1.0, "own"): 1})


def test_urls_both_ways(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    rows = [("http://q.example.NET/en/1?a#b", "example.net/en/", "allow"), ("http://example.net/fr", "net/", "block"), ("http://example.net", None, "allow"), ("https://w.a.org/xyz", "a.org/x", "block"), ("http://ba.org/x", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("", None, "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string").withColumn("h", F.lit(1))
    for most in (100, 1):
        got = {r.page_id: r.judged for r in urls.judged(pages, rules, most_rules=most).collect()}
        assert [(got[i].rule, got[i].verdict) for i in range(len(rows))] == [(r, v) for _, r, v in rows]
        assert got[0].host == "q.example.net" and got[0].path == "/en/1"


def test_urls_of_odd_pages(spark):
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    long = "http://a.net/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://" + "a." * 20_000 + "net/")], "page_id long, url string").withColumn("judged", F.lit("old"))
    for most in (100, 0):
        got = urls.judged(pages, rules, most_rules=most).collect()
        assert [r.judged.verdict for r in got] == ["block"] * 3
        assert urls.judged(pages.limit(0), rules, most_rules=most).count() == 0
        assert {r.judged.verdict for r in urls.judged(pages, rules.limit(0), most_rules=most).collect()} == {"allow"}


def test_toxicity_finds_the_sentence(spark):
    bad = "You are a worthless idiot."
    rows = [(i, prose(i, 60) + (" " + bad + " " if i % 3 == 0 else " ") + prose(200 + i, 30)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    text = dict(rows)
    for r in toxicity.scored(docs(spark, rows), model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 3 == 0)
        assert all("idiot" in text[r.doc_id][s.start : s.end] for s in r.spans)
    assert toxicity.fit(docs(spark, rows), labels.where("toxic = 0"))["weights"] == {}


def test_noisy_or_by_brute_force(spark):
    import numpy as np

    rows = [(1, "Bad day. good bad bad day! nothing here\nbad"), (2, None), (3, "..."), (4, "good. good. good."), (4, "bad " * 9), (5, prose(1, 5_000) + " BAD?")]
    weights, bias = {"^bad$": 3.5, "^good": -1.25, "bad$": 0.5, "^day$": 1.0}, -3.0

    def chance(sentence):
        held = set().union(*[toxicity.features(w) for w in re.findall(r"[^\W\d_]+", sentence)])
        return 1 / (1 + math.exp(-bias - sum(x for f, x in weights.items() if f in held)))

    got = toxicity.scored(docs(spark, rows), {"weights": weights, "bias": bias}).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id, r.score)), sorted(rows, key=lambda x: (x[0], "bad" in (x[1] or "")))):
        low = (t or "").lower()
        parts = [m for m in re.finditer(r"[^.!?\n]+[.!?\n]*", low)]
        assert r.doc_id == i and r.score == pytest.approx(1 - math.prod(1 - chance(m.group()) for m in parts), abs=1e-12)
        assert [(s.start, s.end) for s in r.spans] == [m.span() for m in parts if chance(m.group()) >= 0.5]
    # The gradient, against differences of the likelihood worked out in loops.
    bags, y, rest = [[[0, 2], [1]], [[1, 2]], [], [[0]]], np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.0, 2.0, 1.0, 0.0])
    flat = [s for b in bags for s in b]
    doc = np.repeat(np.arange(4), [len(b) for b in bags])
    sentence, word = np.repeat(np.arange(len(flat)), [len(s) for s in flat]), np.array([k for s in flat for k in s])

    def slow(w, b):
        total = 0.0
        for d in range(4):
            clean = math.prod(1 - 1 / (1 + math.exp(-b - sum(w[k] for k in s))) for s in bags[d]) * (1 - 1 / (1 + math.exp(-b))) ** rest[d]
            total -= math.log(1 - clean) if y[d] else math.log(clean)
        return total / 4

    w, b, h = np.array([0.3, -0.7, 1.1]), -0.4, 1e-6
    value, grad = toxicity.loss(w, b, y, rest, doc, sentence, word)
    assert value == pytest.approx(slow(w, b), rel=1e-9)
    numeric = [(slow(w + h * np.eye(3)[k], b) - slow(w - h * np.eye(3)[k], b)) / (2 * h) for k in range(3)] + [(slow(w, b + h) - slow(w, b - h)) / (2 * h)]
    assert grad == pytest.approx(numeric, rel=1e-5, abs=1e-8)


def test_toxicity_fit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (5, 1), (5, 0), (8, 0), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert set(model) == {"weights", "bias"}
    assert toxicity.fit(empty(spark), labels)["weights"] == {} and toxicity.fit(odd, labels.where("false"))["weights"] == {}
    rows = [(i, ("awful " if i % 2 else "fine ") + prose(i, 12)) for i in range(60)] * 3
    many = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    whole = toxicity.fit(docs(spark, rows), many)
    assert whole == toxicity.fit(docs(spark, rows[:60]), many)  # equal rows count as one
    few = toxicity.fit(docs(spark, rows), many, fit_chars=10)
    assert few["weights"] == {}  # no text is within the bound


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_toxicity_fit_deals_no_texts(spark):
    """Only the sample's texts are dealt, however many there are."""
    rng = random.Random(3)
    rows = [(i, ("awful " if i % 2 else "fine ") + prose(i, 12)) for i in range(40)]
    rest = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=8000))) for i in range(40, 400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, None) for i in range(40, 400)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        model = toxicity.fit(docs(spark, rows + rest), labels)
        assert shuffled(spark) - before < 500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert model == toxicity.fit(docs(spark, rows), labels)


def test_toxicity_of_odd_rows(spark, odd):
    out = toxicity.scored(odd, {"weights": {"^bad$": 3.0}, "bias": -8.0}).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(empty(spark), {"weights": {}, "bias": -8.0}).count() == 0


def test_lines_of_web_pages_fail(spark):
    bad = ["Home | About | Contact us", "Start \u00bb Produkte \u00bb Schuhe und Taschen", "Home > Shop > Shoes", "Startseite Impressum Kontakt", "Accueil Connexion", "Inicio Buscar Ayuda", "This site uses cookies to serve you.", "Diese Seite verwendet Cookies.", "Lisez les mentions l\u00e9gales.", "Lea la pol\u00edtica de privacidad.", "Seite nicht gefunden.", "BUY NOW BUY NOW BUY NOW", "no full stop at its end"]
    good = ["We went home to search for the next bus.", "Er ging zur\u00fcck nach Hause.", "A | B is a choice.", "| a | b | c |", "home", "Fin.", ""]
    got = quality.judged(docs(spark, [(i, x) for i, x in enumerate(bad + good)])).select("doc_id", "quality.lost_chars", "quality.word_chars", "quality.text").collect()
    for r in got:
        if r.doc_id < len(bad):
            assert r.lost_chars == r.word_chars > 0 and r.text == "", bad[r.doc_id]
        elif "|" not in good[r.doc_id - len(bad)]:
            assert r.lost_chars == 0, good[r.doc_id - len(bad)]


def test_repeat_words_by_brute_force(spark):
    texts = ["a b c d e a b c d e", "a " * 12, "a b c d e f g", "", None, "x a b c d e y a b c d e z a b c d e", "a b c d"]
    want = []
    for t in texts:
        w = (t or "").split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        want.append(len({i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}))
    got = quality.judged(docs(spark, list(enumerate(texts)))).select("doc_id", "quality.n_repeat_words").collect()
    assert [r.n_repeat_words for r in sorted(got)] == want


def test_near_copies_in_groups_larger_than_a_block(spark, monkeypatch):
    """Many different texts of many lengths around one passage, pairs of near-copies among them: the
    classes are the same however small the blocks are."""
    passage, rows = prose(900, 40, 100), []
    for i in range(24):
        words = f"{prose(1000 + i, 12 + 7 * (i % 8), 100)} {passage} {prose(2000 + i, 10, 100)}".split()
        rows.append((2 * i, " ".join(words)))
        if i % 3 == 0:
            words[5] = words[-5] = "changed"
            rows.append((2 * i + 1, " ".join(words)))
    frame = docs(spark, rows)
    want = {r.doc_id: r.class_id for r in nearcopies.classes(frame).collect()}
    assert all(want[2 * i + 1] == want[2 * i] for i in range(0, 24, 3))
    for block in (3, 7):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in nearcopies.classes(frame).collect()} == want
