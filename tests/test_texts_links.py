"""Links in texts, addresses, words, keys, triples and loads, against plain versions."""

import hashlib
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, urls
from lodestone.operators import fulltext, graph, linking
from lodestone.sources import files
from lodestone.sources.snapshots import exists


def plain_links(t, labels, whole):
    """Leftmost, then longest, by trying every label at every place."""
    out, i = [], 0
    by = {}
    for label, url in sorted(x for x in labels if None not in x):
        if label:
            by.setdefault(label.lower(), url)
    word = lambda k: 0 <= k < len(t) and (t[k].isalnum() or t[k] == "_")
    while i < len(t):
        fit = [x for x in by if t[i : i + len(x)].lower() == x and not (whole and (word(i - 1) or word(i + len(x))))]
        if fit:
            n = max(map(len, fit))
            out.append(f"[{t[i : i + n]}]({by[t[i : i + n].lower()]})")
            i += n
        else:
            out.append(t[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most", [linking.MOST_CHARS, 0], ids=["broadcast", "join"])
def test_links_equal_a_plain_version(spark, whole, most):
    r = random.Random(3)
    bits = ["data", "Data school", "school", "é", "a", "ab", "C++", "the", "SCHOOL bus", "data_x", "bus"]
    labels = [(b, f"http://u/{i}") for i, b in enumerate(bits)] + [("", "http://no"), ("the", None), ("DATA", "http://second"), ("x y z", "http://u/xyz"), ("+.", "http://u/sign")]
    texts = [" ".join(r.choice([*bits, "dataschool", "É", "cab", "C++.", "x y", "z"]) for _ in range(r.randint(0, 12))) for _ in range(60)] + ["", None, "data " * 3000, "İstanbul data"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("w", F.lit(1))
    if not whole and most == 0:  # labels inside words are found by scanning alone
        with pytest.raises(ValueError):
            linking.autolinked(rows, "t", spark.createDataFrame(labels, "label string, url string"), ["id"], whole, most)
        return
    got = {x.id: x.t for x in linking.autolinked(rows, "t", spark.createDataFrame(labels, "label string, url string"), ["id"], whole, most).collect()}
    assert got == {i: None if t is None else plain_links(t, labels, whole) for i, t in enumerate(texts)}


def test_ten_thousand_labels(spark):
    labels = spark.range(10_000).select(F.concat(F.lit("item "), F.col("id").cast("string")).alias("label"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    rows = spark.createDataFrame([(1, "see item 77 and Item 7777, not item 77777")], "id int, t string")
    want = "see [item 77](u77) and [Item 7777](u7777), not item 77777"
    assert [linking.autolinked(rows, "t", labels, ["id"], most=m).first().t for m in (linking.MOST_CHARS, 0)] == [want, want]


#: The examples of RFC 3986, section 5.4, against http://a/b/c/d;p?q
EXAMPLES = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s|g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g|../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|http:g http:g"""


def test_addresses_by_the_rules(spark):
    cases = [("http://a/b/c/d;p?q", *x.split(" ")) for x in EXAMPLES.split("|")]
    cases += [("http://a/b/c/d;p?q", "", "http://a/b/c/d;p?q"), ("http://h", "x", "http://h/x"), (None, "/x", "/x"), ("http://h/a#f", None, "http://h/a"), (None, None, None), ("http://h/a/b", "mailto:x@y", "mailto:x@y"), ("http://h/a", " /b c ", "http://h/b c")]
    frame = spark.createDataFrame(cases, "b string, r string, want string")
    got = frame.select("b", "r", "want", urls.resolved(F.col("b"), F.col("r")).alias("got"))
    assert [tuple(x) for x in got.where(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []


def test_words_of_any_script_in_the_jvm(spark):
    r = random.Random(9)
    pools = ["abcXYZ019_-' ", "éÉñÑçßøŁłİıŒœ", "ΑΒΓάέώϊΐΣσς", "ЁёЙйЖж", "اَبِتْ", "नमस्ते", "中文字漢", "가각힣", "ǅᾳⅫ²½", "éäô", "𝒜𐐀𐐨", "  \t\n"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in rows.select("i", text.index_tokens(F.col("t")).alias("ws")).collect():
        assert x.ws == (None if texts[x.i] is None else text.index_words(texts[x.i])), texts[x.i]
    assert "Python" not in fulltext.postings(rows, "i", ["t"])._jdf.queryExecution().toString()
    for c, bare in zip(text.MARKED, text.BARE):
        assert [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")] == [bare]


def test_stemmed_postings_count_all_forms(spark):
    rows = spark.createDataFrame([(1, "diving dived dives dive"), (2, "diving")], "i int, t string")
    assert {(x.i, x.token): x.tf for x in fulltext.postings(rows, "i", ["t"], True).collect()} == {(1, "dive"): 4, (2, "dive"): 1}


def test_one_form_of_json(spark):
    values = [{"b": [1, {"z": None, "a": "é\n\"\\/ 😀"}], "a": {}, "": [], "é": True, "B": -5}, [], "x", 7, None, [[{"k": {"y": 2, "x": 1}}]]]
    forms = [(i, f(v)) for i, v in enumerate(values) for f in (json.dumps, lambda v: json.dumps(v, indent=1, ensure_ascii=False), lambda v: json.dumps(v, sort_keys=True))]
    for x in spark.createDataFrame(forms, "i int, j string").select("i", text.canonical_json(F.col("j")).alias("c"), text.versioned_key(F.col("j"), 'v"1').alias("k")).collect():
        want = json.dumps(values[x.i], sort_keys=True, separators=(",", ":"))
        assert x.c == want
        assert x.k == hashlib.sha256(f'{{"payload":{want},"version":"v\\"1"}}'.encode()).hexdigest()
    bad = spark.createDataFrame([("{",), (None,)], "j string").select(text.canonical_json(F.col("j")).alias("c"))
    assert [x.c for x in bad.collect()] == [None, None]


def test_triples_are_read_by_predicate(spark, tmp_path):
    where = str(tmp_path / "t")
    rows = [("a", "knows", "b"), ("b", "knows", "c"), ("c", "name", "007"), ("a", "has/odd p", "x"), ("b", "name", None)]
    spark.createDataFrame(rows, "s string, p string, o string").write.parquet(where)
    stored = graph.store_of(spark.read.parquet(where), "t")
    assert stored.columns == ["s", "p", "o"] and set(map(tuple, stored.collect())) == set(rows)
    found = graph.match(stored, [("?x", "knows", "?y"), ("?y", "name", "?n")])
    assert [tuple(r) for r in found.select("x", "n").collect()] in ([("b", "007"), ("a", None)], [("a", None), ("b", "007")])
    plan = graph.pattern(stored, "?s", "name", "?o")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*p#\d+ = name", plan) and graph.pattern(stored, "?s", "has/odd p", "?o").count() == 1
    spark.createDataFrame([("z", "name", "new")], "s string, p string, o string").write.mode("append").parquet(where)
    assert graph.store_of(spark.read.parquet(where), "t").count() == 6


def test_a_load_stops_for_all_tasks_and_goes_on(spark, tmp_path):
    """Four tasks, a quota of five answers: few calls come after the stop, and the next run asks only for
    what is left."""
    calls, where = tmp_path / "calls", f"file://{tmp_path}/load"
    calls.mkdir()
    quota = tmp_path / "quota"
    quota.write_text("5")

    def fetch(key, kind):
        import os
        import time
        import uuid

        if key == "13":
            raise OSError("down")
        if len([n for n in os.listdir(calls) if n.startswith("ok")]) >= int(quota.read_text()):
            (calls / f"no-{key}-{kind}-{uuid.uuid4().hex}").touch()
            raise files.Spent
        (calls / f"ok-{key}-{kind}-{uuid.uuid4().hex}").touch()
        time.sleep(0.02)
        return f"{key}/{kind}"

    keys = spark.range(20).repartition(4).select(F.col("id").alias("key"))
    run = lambda: files.loaded(keys, "key", fetch, where, ["a", "b"], retry=2, tries=1, wait=0.0)
    rows, stopped = run()
    first = rows.collect()
    assert stopped and 5 <= sum(r.error is None for r in first) <= 9 and exists(spark, f"{where}/stops/000001")
    assert len([n for n in calls.iterdir() if n.name.startswith("no")]) <= 4  # at most one a task
    quota.write_text("1000")
    rows, stopped = run()
    got = {(r.key, r.kind): (r.payload, r.error) for r in rows.collect()}
    assert not stopped and len(got) == 40 and all(v == (f"{k}/{kind}", None) for (k, kind), v in got.items() if k != "13")
    assert got["13", "a"][1] == "OSError: down"
    asked = [n.name.split("-")[1:3] for n in calls.iterdir() if n.name.startswith("ok")]
    assert len(asked) == len({tuple(x) for x in asked}) == 38
    run()
    rows, _ = run()  # two failures are enough: nothing is left to ask
    assert rows.count() == 40
