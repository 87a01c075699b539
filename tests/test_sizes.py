"""Steps that once grew faster than their input: what they hold, send and give, on small rows."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext, joins, located, similar
from lodestone.sources import web


def sent(frame) -> set[str]:
    """The columns that a plan broadcasts."""
    found, waiting = set(), [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "BroadcastExchange":
            found |= {node.output().apply(i).name() for i in range(node.output().size())}
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("most", [joins.MOST_CHARS if hasattr(joins, "MOST_CHARS") else 0, 0])
def test_texts_are_not_broadcast(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(joins, "MOST_CHARS", most, raising=False)
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else " ".join(rng.choice("red Hot blue, gear. bolt nut the ring".split()) for _ in range(rng.randrange(0, 9)))) for i in range(300)] * 2
    names = ["the", "Hot gear", "hot", "bolt  nut", "", "absent", "hot"]
    spark.createDataFrame(rows, "n int, y string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    asked = spark.sparkContext.parallelize([(w,) for w in names], 2).toDF("w string")
    got = joins.named_in_text(texts, asked, F.col("y"), "w")
    clean = lambda x: " ".join(re.findall("[a-z0-9]+", x.lower()))
    want = sorted((n, w) for n, y in rows for w in names if y is not None and clean(w) and f" {clean(w)} " in f" {clean(y)} ")
    assert got.columns == ["n", "y", "w"] and sorted((r.n, r.w) for r in got.collect()) == want
    assert not sent(got) & {"_text", "y"}


def test_nearest_of_rows_far_from_a_crowd(spark, monkeypatch):
    """Rows far from where all others lie are compared with few of them, and find the right ones."""
    def geo_miles(lat1, lon1, lat2, lon2):
        a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(min(1.0, a)))

    rng = random.Random(2)
    crowd = [(i, 25 + abs(rng.gauss(0, 0.2)), -120 + rng.gauss(0, 0.2)) for i in range(4000)] + [(4000 + i, 25.0, -120.0) for i in range(50)] + [(5000, 48.0, 179.99)]
    alone = [(i, 48 + rng.random(), rng.uniform(-70, -60)) for i in range(20)] + [(100, 48.1, -179.99), (101, -89.9, 10.0)]
    a, b = spark.createDataFrame(alone, "a int, lat double, lon double"), spark.createDataFrame(crowd, "b int, y double, x double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(*at):
        seen.add(1)
        return geo_miles(*at)

    monkeypatch.setattr(located, "haversine", lambda *at: counted(*at))
    got = located.geo_knn_join(a, b, 3, "a", "b", right_lat="y", right_lon="x")
    held = {(r.a, r["rank"], r.b) for r in got.collect()}
    assert got.columns == ["a", "lat", "lon", "b", "y", "x", "miles", "rank"]
    assert held == {(i, k + 1, j) for i, *p in alone for k, (_, j) in enumerate(sorted((geo_miles(*p, *q), j) for j, *q in crowd)[:3])}
    assert seen.value < 0.1 * len(alone) * len(crowd)


def test_scores_of_few_queries_and_rows_at_once(monkeypatch):
    """A task's memory does not grow with queries times rows, and its lists are right."""
    r, k = np.random.default_rng(3), 4
    v = np.round(r.normal(size=(3000, 8)), 1)
    v[::7] = v[0]
    ids, unit = np.arange(1000), v / np.sqrt((v * v).sum(1, keepdims=True))
    largest, rounded = [0], np.round
    monkeypatch.setattr(similar, "ASKED", 64, raising=False)
    monkeypatch.setattr(similar, "ROWS", 128, raising=False)
    monkeypatch.setattr(similar.np, "round", lambda x, n: (largest.append(x.size), rounded(x, n))[1])
    rows = [pa.record_batch([pa.array(np.arange(a, a + 1500)), pa.array(list(v[a : a + 1500]))], ["key", "v"]) for a in (0, 1500)]
    got = [x for b in similar._pass(iter(rows), ids, unit[:1000], k, 0.3, False) for x in b.to_pylist()]
    monkeypatch.undo()
    want = set()
    for q in range(1000):
        scores = np.round(unit[q : q + 1] @ unit.T, 6)[0]
        want |= {(q, int(i)) for i in sorted((i for i in np.flatnonzero(scores >= 0.3) if i != q), key=lambda i: (-scores[i], i))[:k]}
    assert {(x["q"], x["key"]) for x in got} == want and len(got) == len(want)
    assert max(largest) <= 64 * 128


def test_a_word_of_all_rows_is_in_many_files(spark, tmp_path):
    """The postings of one word are not one task's, and an index is dealt once."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(400).select("id", F.lit("the red").alias("a"), F.concat(F.lit("the w"), "id").alias("b"))
        index = fulltext.write_index(docs, "id", ["a", "b"], str(tmp_path / "index"), stemmed=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.postings.where("token = 'the'").select(F.input_file_name()).distinct().count() > 1
    got = {tuple(r) for r in index.postings.select("id", "field", "token", "tf").collect()}
    assert got == {x for i in range(400) for x in ((i, "a", "the", 1), (i, "a", "red", 1), (i, "b", "the", 1), (i, "b", f"w{i}", 1))}


def test_few_pages_are_parsed_at_once(spark, monkeypatch):
    """A batch's pages are held as Arrow's, and parsed a few at a time."""
    pages = [f"<title>t{i}</title><a href='/{i}'>x {i}</a><a>y</a>" for i in range(web.AT_ONCE * 2 + 5)] + [None, ""]
    got = web.parsed(spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1), "html").orderBy("i").collect()
    assert [(r.page.title, r.page.text, [tuple(x) for x in r.page.links]) for r in got[:-2]] == [(f"t{i}", [f"x {i}", "y"], [(f"/{i}", f"x {i}")]) for i in range(len(pages) - 2)]
    assert [(r.page.title, r.page.text, r.page.links) for r in got[-2:]] == [("", [], [])] * 2
    tracemalloc.start()
    html = "<p>some words</p>" * 100
    web._structs([html] * web.AT_ONCE)
    few = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    parse = web.parse_batch(pa.array([html] * (web.AT_ONCE * 8)))
    assert len(parse) == web.AT_ONCE * 8 and tracemalloc.get_traced_memory()[1] < 2 * few
    tracemalloc.stop()


@pytest.mark.parametrize("stemmed", [False, True])
def test_words_are_counted_where_they_are_read(spark, tmp_path, monkeypatch, stemmed):
    """Rows of different keys are not dealt; what is counted is the same, and rows that share a key are one document."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices(["dive", "Diving", "dived", "Été", "中文", "x1", "ΣΑΣ"], k=rng.randrange(0, 40))), rng.choice([None, "", "red dives"])) for i in range(300)] + [(None, "dive dive", "red")]
    docs = spark.createDataFrame(texts, "id int, a string, b string")
    monkeypatch.setattr(fulltext, "AT_ONCE", 100)
    assert "Exchange" not in fulltext.counted_in_place(docs, "id", ["a", "b"], stemmed)._jdf.queryExecution().executedPlan().toString()
    for rows, name in ((docs, "one"), (docs.union(docs.limit(9)), "two")):
        index = fulltext.write_index(rows, "id", ["a", "b"], str(tmp_path / name), stemmed)
        got = Counter(tuple(r) for r in index.postings.select("id", "field", "token", "tf").collect())
        assert got == Counter(tuple(r) for r in fulltext.postings(rows, "id", ["a", "b"], stemmed).collect()) and max(got.values()) == 1


def most_joined(frame) -> int:
    """The most rows that a join of a plan made when it ran."""
    frame.collect()
    most, waiting = 0, [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName() or node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            node = node.plan()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("find", [joins.best_token_match, joins.find_name])
def test_equal_names_are_asked_once(spark, find):
    queries = spark.createDataFrame([(i, "red gear bolt" + " Bolt" * (i % 2)) for i in range(600)], "q int, x string")
    names = spark.createDataFrame([(i, "Gear, Bolt red nut" if i % 3 else "gear bolt RED nut!") for i in range(300)], "n int, y string")
    got = find(queries, names, "q", "x", "n", "y")
    rows = got.collect()
    assert len(rows) == 600 and {r.n for r in rows} == {0} and {r.score for r in rows} == {1.0}
    assert most_joined(got) <= 1200


def test_zip_fallback_tries_no_pairs(spark):
    from lodestone.plans import catalog

    rng = random.Random(4)
    z = {f"{rng.randrange(12000, 12900):05d}": rng.random() for _ in range(200)}
    f = [(i, f"{rng.randrange(12000, 13100):05d}") for i in range(800)]
    views = {"zcta": spark.createDataFrame([(a, b, 0.0) for a, b in z.items()], "zip string, lat double, lon double"), "facility": spark.createDataFrame(f, "code int, zip string")}

    class Given:
        zcta, facility = views["zcta"], views["facility"]

    got = catalog.QUERIES["zip_fallback"].__closure__[0].cell_contents(Given)
    want = {i: z[min((abs(int(a) - int(x)), x) for x in z if x[:3] == a[:3])[1]] for i, a in f if any(x[:3] == a[:3] for x in z)}
    assert {r.code: r.lat for r in got.collect()} == want
    assert most_joined(got) <= 2 * len(f)
