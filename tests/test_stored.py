"""Stores of versions, indexes that follow their tables, and searches that read them."""

import pytest
from pyspark.sql import functions as F

from lodestone.api import Catalog, Engine
from lodestone.operators import fulltext, tables
from lodestone.search import Spec, matching, program_index, program_pages, program_search, tiers
from lodestone.sources.snapshots import Conflict, Store, fingerprint


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, seq int")


def test_versions_merge_and_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.manifest() is None and store.versions() == []
    with pytest.raises(KeyError):
        store.read()
    store.commit({"rows": rows_of(spark, [(1, "a", 1), (2, "b", 1), (3, "c", None)]), "more": spark.range(2)})
    store.merge(rows_of(spark, [(1, "A", 2), (2, "old", 0), (4, "d", None), (4, "e", 5), (3, "C", 1)]), ["k"], "seq", spark.createDataFrame([(9,)], "k int"))
    assert sorted(map(tuple, store.read().collect())) == [(1, "A", 2), (2, "b", 1), (3, "C", 1), (4, "e", 5)]
    store.merge(rows_of(spark, []), ["k"], "seq", spark.createDataFrame([(1,), (None,)], "k int"))
    assert sorted(r.k for r in store.read().collect()) == [2, 3, 4] and store.read("more").count() == 2
    assert sorted(r.k for r in store.read(version=1).collect()) == [1, 2, 3]
    assert store.vacuum(1) == 2 and store.versions() == [3] and store.read().count() == 3


def test_failed_and_second_writers_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"rows": spark.range(3)})
    held = store.read()

    def broken(rows):
        return rows.select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        store.changed(broken)
    assert store.versions() == [1] and store.read().count() == 3
    store.changed(lambda rows: rows.where("id > 0"))
    with pytest.raises(Conflict):
        store.commit({"rows": spark.range(9)}, after=1)
    assert store.read().count() == 2 and held.count() == 3
    assert store.vacuum(5) == 0 and store.read().count() == 2  # the folders of failed writers went


def test_fingerprints(spark, tmp_path):
    where = str(tmp_path / "t x")
    spark.range(5).write.parquet(where)
    read = lambda: spark.read.parquet(where)
    first = fingerprint(read())
    assert first == fingerprint(read()) and first != fingerprint(read(), "v2") and first != fingerprint(read().where("id > 1"))
    spark.range(1).write.mode("append").parquet(where)
    assert fingerprint(read()) != first and fingerprint(spark.createDataFrame([(1,)], "a int")) is None


def test_an_index_follows_its_table(spark, tmp_path):
    """Two tables under one name, and one that changes: never another's words."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(1, "red fox"), (2, "dog")], "id int, t string").write.parquet(one)
    spark.createDataFrame([(7, "red hen")], "id int, t string").write.parquet(two)
    find = lambda w: {r.id for r in fulltext.index_of(spark.read.parquet(w), "id", ["t"], "same name").matches([["red"]]).collect()}
    assert find(one) == {1} and find(two) == {7} and find(one) == {1}
    spark.createDataFrame([(3, "red ant")], "id int, t string").write.mode("append").parquet(one)
    assert find(one) == {1, 3}
    memory = lambda rows: {r.id for r in fulltext.index_of(spark.createDataFrame(rows, "id int, t string"), "id", ["t"], "m").matches([["red"]]).collect()}
    assert memory([(1, "red")]) == {1} and memory([(2, "red")]) == {2}


@pytest.fixture(scope="module")
def catalog(spark):
    programs = [(1, "X", "blue widget"), (1, "X", "blue widget"), (1, None, "blue widget"), (1, "", "blue widget"), (2, "X", "blue paint"), (3, "X", "widget shop"), (3, "X", "bluewidget maker"), (4, "X", "green")]
    facilities = [(1, "delta", "ND", True, 40.0, -100.0), (2, "Alpha", "ND", True, 41.0, -100.0), (3, "beta", "SD", True, 42.0, -100.0), (4, "gamma", "SD", False, 42.0, -100.0)]
    p = spark.createDataFrame(programs, "code long, ptype string, description string")
    f = spark.createDataFrame(facilities, "code long, name string, state string, approved boolean, lat double, lon double")
    return p, f


def test_equal_programs_count_once_and_null_is_not_empty(catalog):
    p, f = catalog
    got = {r.code: r for r in program_search(p, f, Spec(["blue", "widget"])).collect()}
    assert set(got) == {1, 3} and got[1].n_programs == 3 and got[1].total_programs == 4


def test_tiers_agree_with_each_by_itself(catalog):
    p, _ = catalog
    spec = Spec(["blue", "paint"])
    held = {(r.code, r.description): (r.tier, r.hits) for r in tiers(p, spec).collect()}
    assert held[(2, "blue paint")] == (0, 2) and held[(1, "blue widget")] == (1, 1) and (4, "green") not in held
    strict = {(r.code, r.description): r["rank"] for r in matching(p, spec, True).collect()}
    loose = {(r.code, r.description): r["rank"] for r in matching(p, spec, False).collect()}
    assert set(strict) == {(2, "blue paint")} and strict.items() <= loose.items() and len(loose) == 2


def test_orders_and_pages(catalog):
    p, f = catalog
    codes = lambda **k: [r.code for r in program_search(p, f, Spec(["blue", "zebra"], **k)).collect()]
    assert codes(at=(41.0, -100.0)) == [2, 1] and codes(order="name") == [2, 1] and codes(order="rank", state="nd")[:1] in ([1], [2])
    assert codes(at=(40.0, -100.0), order="distance", size=1) == [1] and codes(at=(40.0, -100.0), miles=10.0) == [1]
    for wrong in ({"order": "distance"}, {"order": "size"}):
        with pytest.raises(ValueError):
            Spec(["blue"], **wrong)


def test_fallback_by_meaning_honours_state_and_radius(spark, catalog):
    p, f = catalog
    alike = spark.createDataFrame([("blue paint", 0.9), ("widget shop", 0.8), ("green", 0.95)], "description string, score double")
    found = lambda **k: [(r.code, r.best_rank) for r in program_search(p, f, Spec(["quokka"], **k), alike).collect()]
    assert found() == [(2, -0.9), (3, -0.8)] and found(state="sd") == [(3, -0.8)] and found(at=(42.0, -100.0), miles=80.0) == [(3, -0.8), (2, -0.9)]
    assert [r.code for r in program_search(p, f, Spec(["green"]), alike).collect()] == [2, 3]  # the only word match is not approved


def test_field_tiers_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox", "", ""), (2, "red", "hen", "fox"), (3, "cow", "", "red fox fox"), (4, "fox", "red fox", ""), (5, "ant", "", ""), (6, None, None, "redder")], "id int, a string, b string, c string")
    posts = fulltext.postings(docs, "id", ["a", "b", "c"])
    index = fulltext.Index(posts, fulltext.lengths(posts, "id"), "id")
    weights = {"a": 12.0, "b": 9.0, "c": 2.0}
    got = [(r.id, r.tier) for r in fulltext.field_tiers(index, ["red", "fox"], ["a", "b"], weights, 10).collect()]
    assert dict(got) == {1: 0, 4: 0, 2: 1, 3: 2, 6: 2} and [t for _, t in got] == sorted(t for _, t in got)
    main = {r.id: r.score for r in fulltext.bm25(posts, "id", [["red"], ["fox"]], weights=weights, fields=["a", "b"]).collect()}
    every = {r.id: r.score for r in fulltext.bm25(posts, "id", [["red"], ["fox"]], weights=weights).collect()}
    for r in fulltext.field_tiers(index, ["red", "fox"], ["a", "b"], weights, 10).collect():
        assert r.score == pytest.approx((main if r.tier < 2 else every)[r.id], abs=1e-6)
    assert [r.id for r in fulltext.field_tiers(index, ["o'ne"], ["a"], weights, 3).collect()] == []


def test_engine_reads_the_stored_index(spark):
    from lodestone.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    e = Engine(Catalog(t.facility, t.program, t.zcta, t.triples, t.crosswalk, t.completions, name="test catalog"))
    plan = e.catalog.programs().postings._jdf.queryExecution().toString()
    assert "lineitem" not in plan and e.program_search(["blue"]).count() > 0
    found = e.search_entities(t.part, "p_partkey", ["p_name", "p_type"], ["blue", "brass"], 9)
    assert "part.parquet" not in found._jdf.queryExecution().toString() and [r.tier for r in found.collect()] == sorted(r.tier for r in found.collect())
    zips = [r.zip for r in t.zcta.limit(3).collect()]
    near = e.call("nearby_zip", zips=[*zips, "none"], miles=3000.0, k=2).collect()
    assert {r.zip for r in near} <= set(zips) and near and all(r.miles <= 3000 for r in near)


def test_equal_sequences_have_one_winner(spark):
    rows = rows_of(spark, [(1, "a", 1), (1, "b", 1), (2, None, None), (2, "x", None)])
    got = {tuple(r) for n in (1, 3) for r in tables.last_wins(rows.repartition(n), ["k"], "seq").collect()}
    assert len(got) == 2
    assert {r.v for r in tables.last_wins(rows, ["k"], "seq", ["v"]).collect()} == {"b", "x"}


def test_an_index_of_programs_holds_them(spark, catalog):
    p, _ = catalog
    index = program_index(p)
    assert index.rows.count() == 7 and index.lengths.count() == 7


def test_programs_of_one_description_are_indexed_once(spark, catalog):
    """Words are kept by description, while ranks count each program."""
    p, f = catalog
    index = program_index(p)
    assert index.postings.where("token = 'blue'").count() == 2 and {(r.description, r.copies) for r in index.texts.collect()} >= {("blue widget", 3), ("green", 1)}
    each = p.distinct().withColumn("pid", F.xxhash64(F.col("ptype").isNull(), "code", "ptype", "description"))
    posts = fulltext.postings(each, "pid", ["description"])
    for every in (True, False):
        spec = Spec(["blue", "widget"])
        scores = fulltext.bm25(posts, "pid", spec.prefixes(), every=every, compound=spec.joined())
        want = {(r.code, r.ptype, r.description): round(r.score, 6) for r in each.join(scores, "pid").collect()}
        assert {(r.code, r.ptype, r.description): r["rank"] for r in matching(p, spec, every).collect()} == want
    specs = [Spec(["blue", "zebra"], at=(40.0, -100.0), order=o) for o in ("name", "distance")]
    assert [[r.code for r in x.collect()] for x in program_pages(p, f, specs)] == [[2, 1], [1, 2]]
    with pytest.raises(ValueError):
        program_pages(p, f, [Spec(["blue"]), Spec(["green"])])


def test_program_view_keeps_nulls(spark):
    from lodestone.plans.tables import Tables

    class Given(Tables):
        part = spark.createDataFrame([(1, "a", "X", None), (2, "a", "X", None), (3, None, "X", "T"), (4, "b", "Y", "T"), (5, "c", "Y", "T")], "p_partkey long, p_name string, p_brand string, p_type string")
        lineitem = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 2), (8, 4), (8, 4), (9, 6)], "l_suppkey long, l_partkey long")

    got = [tuple(r) for r in Given(spark, "").program.collect()]
    assert len(got) == 4 and set(got) == {(7, None, "a x"), (7, "T", None), (8, None, "a x"), (8, "T", "b y")}


def test_arguments_are_coerced(spark):
    from lodestone.api import RequestError, coerced

    assert coerced("37.5", "float") == 37.5 and coerced(" 7 ", "int") == 7 and coerced("7", "int | None") == 7 and coerced("", "int | None") is None
    assert coerced("yes", "bool | None") is True and coerced("a, b", "list[str]") == ["a", "b"] and coerced("a, b", "list[str] | str") == "a, b" and coerced(3.0, "int") == 3
    from lodestone.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    e = Engine(Catalog(t.facility, t.program, t.zcta, t.triples, t.crosswalk, t.completions))
    assert e.call("nearby", lat="37.0", lon="-95", miles="5000", k="3").count() == 3
    for wrong in ({"lat": "north", "lon": 1}, {"lat": 1.0, "lon": 2.0, "k": "2.5"}):
        with pytest.raises(RequestError):
            e.call("nearby", **wrong)


def test_find_name_by_all_rules(spark):
    import random
    import re

    from lodestone.operators import joins

    r = random.Random(4)
    words = ["the", "tech", "technical", "state", "art", "arts", "college", "of", "north"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(60)] + ["", None]
    asked = [" ".join(r.choice([*words, "col", "echnical"]) for _ in range(r.randint(1, 5))) for _ in range(60)] + ["", None, "THE-ARTS"]
    norm = lambda x: " ".join(re.findall("[a-z0-9]+", (x or "").lower()))
    want = {}
    for i, q in enumerate(asked):
        x, best = norm(q), None
        for j, name in enumerate(names):
            y = norm(name)
            share = len(set(x.split()) & set(y.split())) / max(1, len(set(x.split())))
            if x and (x == y or share >= 0.75 or (share > 0 and x in y)):
                best = min(filter(None, [best, (x != y, -share, len(name), j)]))
        if best:
            want[i] = (best[3], -best[1])
    a = spark.createDataFrame(list(enumerate(asked)), "q int, x string")
    b = spark.createDataFrame(list(enumerate(names)), "n int, y string")
    assert {r.q: (r.n, r.score) for r in joins.find_name(a, b, "q", "x", "n", "y").collect()} == want
