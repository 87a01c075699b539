"""Operators 11 to 13: product codes, main text of pages, hard negatives; against plain versions."""

import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codes, negatives, queries, wrappers

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def some(n, width=16, seed=1, step=1.0):
    r = random.Random(seed)
    return [(i, [step * r.randint(-3, 3) / 8 for _ in range(width)], r.choice([0, 1, 2, None])) for i in range(n)]


ODD = [(None, [0.5] * 16, 1), (1, None, 1), (2, [], 1), (3, [NAN] * 16, 1), (4, [0.25] * 15 + [None], 1), (5, [INF] + [0.0] * 15, 1), (6, [0.1] * 9, 2)]


def plain_codes(rows):
    """Product quantization by loops over whole numbers, as the docstring has it."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [tuple(v[2 * p : 2 * p + 2]) for p in range(8)]
    books = [[cut(v)[p] for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[p], books[p]), []).append(cut(v)[p])
            for e, g in groups.items():
                books[p][e] = tuple(sum(x) // len(g) for x in zip(*g))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        entries = [near(part, books[p]) for p, part in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{e:02x}" for e in entries), sum(far(part, books[p][e]) for (p, part), e in zip(enumerate(cut(v)), entries))))
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, sums[lab], digest) for i, lab, c, e in out), key=repr)


@pytest.mark.parametrize("rows", [some(60), some(60) + ODD, some(5), some(40, seed=3) * 3, some(40, step=1e6)], ids=["even", "odd", "few", "repeats", "large"])
def test_codes_equal_a_plain_version(spark, rows):
    got = codes.coded(vectors(spark, rows).withColumn("code", F.lit("x")).withColumn("part", F.lit(1)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 2)], [(1, [1.0] * 9, 2)]):
        got = codes.coded(vectors(spark, rows))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_trie_walks_subtrees_larger_than_a_bundle(monkeypatch):
    monkeypatch.setattr(codes, "LEAVES", 8)
    r = np.random.default_rng(5)
    parts = np.unique(r.integers(-2, 3, (400, 5)), axis=0)
    book = r.integers(-3, 4, (7, 5))
    code, error = codes.nearest(parts, book)
    far = ((parts[:, None] - book) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    wide, sums = codes.nearest(parts * (1 << 40), book * (1 << 40))
    assert (wide == code).all() and list(sums) == [int(e) << 80 for e in error]


def plain_negatives(rows):
    kept = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in kept:
        if a[0] % 4:
            continue
        order = sorted(((dot(a[2], r[2]), r) for r in kept if r != a), key=lambda x: (-x[0], x[1][0]))
        for p, pos in [x for x in order if x[1][1] == a[1]][:5]:
            fit = [(s, r) for s, r in order if r[1] != a[1] and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(a[0], pos[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("rows", [some(90), some(90) + ODD, some(40, seed=3) * 3, some(90, step=5e6)], ids=["even", "odd", "repeats", "large"])
def test_negatives_equal_a_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(negatives, "ROWS", 10)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "FAN_IN", 2)
    frame = vectors(spark, rows).withColumn("block", F.lit(1)).withColumn("score", F.lit(1))
    got = negatives.mined(frame, F.col("vec_id") % 4 == 0)
    want = plain_negatives(rows)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_send_no_blocks_to_all(spark, monkeypatch):
    """Blocks of anchors, once for each block of rows, were broadcast where their file was small; beyond this
    limit Spark refuses to."""
    monkeypatch.setattr(negatives, "ROWS", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = some(90) + some(90)[::4]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    try:
        got = negatives.mined(vectors(spark, rows), F.col("vec_id") % 4 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_negatives_keep_one_list_of_a_task():
    """A task's pairs, those of two blocks of anchors with five blocks of rows, leave a list for each block of anchors."""
    one = lambda anchors, block: pa.record_batch({"anchors": [anchors], "block": [block]})
    best = lambda pair: negatives._lists(pair, np.array([[[pair["block"][0].as_py() % 3, negatives.NONE]]]), np.array([[[pair["block"][0].as_py(), 0]]]))
    got = pa.Table.from_batches(negatives._kept((one(a, b) for b in (7, 4, 5, 2, 9) for a in (0, 1)), best))
    assert got["anchors"].to_pylist() == [0, 1] and set(got["block"].to_pylist()) <= {7, 4, 5, 2, 9}
    for scores, ids in zip(got["scores"], got["ids"]):
        assert np.frombuffer(scores.as_py(), np.int64).tolist() == [2, 2] and np.frombuffer(ids.as_py(), np.int64).tolist() == [2, 5]


def test_negatives_of_nothing(spark):
    for rows in ([], [(3, [1.0], 1)], [(4, [1.0], 1)], ODD):
        assert negatives.mined(vectors(spark, rows), F.col("vec_id") % 4 == 0).count() == 0


def page(text, nav="Home About", ad="Buy now", wrap="article", share="Share this page", date="", comments="", side="Most read"):
    open_, shut = ("<article>", "</article>") if wrap == "article" else ('<div class="story">', "</div>")
    return (
        f'<!DOCTYPE html><html><head><title>{text[:9]}</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body><div id="top"><ul><li><a href=/>{nav}</a></li></ul></div>'
        f'<div class="ad-box">{ad}</div><!-- <p>no</p> -->{open_}<h1>{text[:12]}</h1><div class=share-line>{share}</div><p class="x9">{text}<br>second &amp; last<p>of {date}'
        f'<ul><li>one {date}</li><li>two <b>bold</b></li></ul><div class="tip">Read our rules before you write</div>{shut}<form><p>Search</p></form>'
        f'<div class="comments"><p>{comments}</p></div><aside>{side}</aside><footer>(c) all</footer></body></html>'
    )


def wanted(text, date=""):
    return "\n".join([text[:12].strip(), f"{text} second & last", f"of {date}".strip(), f"one {date}".strip(), "two bold"])


@pytest.mark.parametrize("wrap", ["article", "div"])
def test_text_of_pages(spark, wrap):
    """What a host's pages share goes, so do adverts, menus, forms, comments; whether marked up or not."""
    words = "amber birch cedar dune ember fjord grove heath inlet".split()
    texts = [f"{a} {b} story number {i} about {b} and {a} with long sentences to tell" for i, (a, b) in enumerate(zip(words, reversed(words)))]
    rows = [(i, f"https://a.example/{i}", page(t, nav=f"menu {i} item", ad=f"advert {i} of the day", date=str(i), comments=f"reader {i} says so", side=f"list {i}", wrap=wrap)) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: wanted(t, str(i)) for i, t in enumerate(texts)}


def test_wrapper_aligns_trees_that_differ(spark):
    """A slot that only some pages have is aligned, and a line they share is found wherever it stands."""
    rows = []
    for i in range(12):
        extra = f"<section><h2>part {i}</h2><p>more of {i * 7} here</p></section>" if i % 3 == 0 else ""
        rows.append((i, "http://b.example/x", f"<body><div class=main><h1>title {i}</h1>{extra}<p>body text {i} {'word ' * (i + 3)}</p><div class=sign>Written by our staff</div></div></body>"))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        extra = f"part {i}\nmore of {i * 7} here\n" if i % 3 == 0 else ""
        assert got[i] == f"title {i}\n{extra}body text {i} {' '.join(['word'] * (i + 3))}"


def test_copies_of_a_page_are_not_template(spark):
    rows = [(i, "http://c.example/", "<article><h1>One title</h1><p>the same text on every page</p></article>") for i in range(5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.text for r in got.collect()} == {"One title\nthe same text on every page"}


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep words here" + "</div>" * 5000
    long = "<article>" + "".join(f"<p>line {i} of a long page</p>" for i in range(20_000)) + "</article>"
    rows = [
        (None, None, "<p>no address</p>"),
        (1, "http://d.example/1", None),
        (2, "http://d.example/2", ""),
        (3, "no scheme", "plain text & more &lt;b&gt; &#233; &copy 1 < 2"),
        (3, "no scheme", "plain text & more &lt;b&gt; &#233; &copy 1 < 2"),
        (4, "http://d.example/4", deep),
        (5, "http://d.example/5", long),
        (6, "http://d.example/6", '<a href="never closed <p>text'),
        (7, "http://d.example/7", "<nav>only a menu</nav><script>never closed <p>x"),
        (8, "http://d.example/8", "<article><p> tabs\tand\n lines <b>in</b>side<p>next</article>"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("TEXT", F.lit("old")).withColumn("wrapper", F.lit(2))
    out = wrappers.extract(frame)
    assert out.columns == ["page_id", "url", "html", "host", "wrapper", "text"]
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[None] == ["no address"] and got[1] == got[2] == [""] and got[7] == [""]
    assert got[3] == ["plain text & more <b> é © 1 < 2"] * 2
    assert got[4] == ["deep words here"] and got[8] == ["tabs and lines inside\nnext"]
    assert got[5] == ["\n".join(f"line {i} of a long page" for i in range(20_000))]
    assert len(got[6]) == 1
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_simple_tree_matching():
    """The size of the best matching, by trying all of them on small trees."""
    r = random.Random(2)

    def tree(depth):
        return wrappers.Node(r.choice("ab"), [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth else [])

    def best(xs, ys):
        if not xs or not ys:
            return 0
        both = 1 + best(xs[0].kids, ys[0].kids) + best(xs[1:], ys[1:]) if xs[0].label == ys[0].label else 0
        return max(both, best(xs[1:], ys), best(xs, ys[1:]))

    for _ in range(200):
        a, b = tree(2), tree(2)
        a.label = b.label = "r"
        want = 1 + best(a.kids, b.kids)
        a.shape, b.shape
        assert wrappers.matched(a, b, {}) == want
        joined = wrappers.merged(a, b)
        joined.shape
        assert joined.size == a.size + b.size - want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_given_pages_give_their_articles(spark):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op12_html_extraction(spark, SF).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id]).group(1)
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", article.replace("<b>", ""))
        want = "\n".join(filter(None, (" ".join(h.unescape(b).split()) for b in blocks)))
        assert (r.text, r.n_chars) == (want, len(want))
