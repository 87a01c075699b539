"""Operators on small rows: rules that the given tables do not show, properties, and plans."""

import io
import random
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.api import Catalog, Engine, RequestError
from lodestone.functions import geo, intent, text, urls, vector
from lodestone.functions.stem import stem
from lodestone.operators import dedupe, fulltext, graph, joins, ranking, tables
from lodestone.places import candidates, resolve_area
from lodestone.search import Lexicon, Spec, matching, program_search
from lodestone.sources import files, snapshots, web


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_bm25_equals_sqlite(spark):
    rng = random.Random(5)
    words = "dive diver diving river boat ship sail sailor harbor port dock deck".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 12))), " ".join(rng.choices(words, k=3))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table d using fts5(id unindexed, a, b, tokenize='unicode61')")
    con.executemany("insert into d values (?, ?, ?)", rows)
    posts = fulltext.postings(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"]).cache()
    cases = [
        ('"div"* OR "sail"*', "bm25(d)", dict(groups=[["div"], ["sail"]])),
        ('("div"* OR "boat"*) AND ("sail"*)', "bm25(d)", dict(groups=[["div", "boat"], ["sail"]], every=True)),
        ('(("div"* AND "port"*)) OR "deck"*', "bm25(d)", dict(groups=[["div"], ["port"]], every=True, compound=["deck"])),
        ('"div"* OR "dock"*', "bm25(d, 0, 12, 2)", dict(groups=[["div"], ["dock"]], weights={"a": 12, "b": 2})),
        ('{a} : ("div"* OR "dock"*)', "bm25(d)", dict(groups=[["div"], ["dock"]], fields=["a"])),
    ]
    for query, rank, options in cases:
        want = dict(con.execute(f"select id, {rank} from d where d match ?", (query,)).fetchall())
        got = {r.id: r.score for r in fulltext.bm25(posts, "id", **options).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want), query


def test_stemmed_prefix_index_over_matches_and_words_verify(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Diving school"), (2, "Divemaster"), (3, "Diversity office"), (4, "Café cooking")], "id int, t string")
    index = fulltext.write_index(rows, "id", ["t"], str(tmp_path))
    posts = index.postings
    assert {r.id for r in fulltext.matches(posts, "id", [["diving"]], stemmed=True).collect()} == {1, 2, 3}
    assert {r.id for r in fulltext.matches(posts, "id", [["cafe"]], stemmed=True).collect()} == {4}
    exact = rows.where(F.col("t").rlike(text.whole_word("diving")))
    assert {r.id for r in exact.collect()} == {1}


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("vietnamization", "vietnam"), ("formative", "form"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("happy", "happi")])
def test_stem(word, root):
    assert stem(word) == root


def test_variants_and_terms():
    assert {"dive", "diver", "diving", "dived"} <= set(text.variants("diving"))
    assert text.variants("bs", {"bs": ["bsc"]}) == ["bs", "bsc"]
    assert text.variants("diver") == ["dive", "dived", "diver", "diving"] and text.variants("dive") == ["dive", "dived", "diver", "diving"]
    assert text.variants("care") == ["care", "cared", "carer", "caring"] and text.variants("speed") == ["speed"]
    assert text.variants("welded") == ["weld", "welded", "welder", "welding"] and text.variants("nursing") == ["nurse", "nursed", "nurser", "nursing"]
    assert text.query_terms("The EMT and the bs of EMT 12", {"the", "and", "of"}, 3, {"bs"}, digits=False) == ["emt", "bs"]


def test_haversine_is_symmetric_and_box_holds_radius(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(400)]
    frame = spark.createDataFrame([*rows, (999, None, 3.0)], "id int, lat double, lon double")
    for at, miles in (((37.0, -95.0), 900.0), ((0.0, 179.5), 1200.0), ((-88.0, 10.0), 700.0)):
        d = geo.haversine(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon"))
        back = geo.haversine(F.col("lat"), F.col("lon"), F.lit(at[0]), F.lit(at[1]))
        assert frame.where(F.abs(d - back) > 1e-6).count() == 0
        brute = {r.id for r in frame.where(d <= miles).collect()}
        assert {r.id for r in frame.where(geo.in_box(F.col("lat"), F.col("lon"), at, miles) & (d <= miles)).collect()} == brute


def test_pages_partition_the_order(spark):
    frame = spark.range(23).withColumn("k", F.col("id") % 5)
    seen = [r.id for o in range(0, 30, 7) for r in ranking.page(frame, ["k", "id"], o, 7).collect()]
    assert seen == [r.id for r in frame.orderBy("k", "id").collect()]


def test_upkeep(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "k int, v string, seq int")
    last = tables.last_wins(rows, ["k"], "seq")
    assert sorted(map(tuple, last.collect())) == [(1, "b", 3), (2, None, 1)]
    assert sorted(map(tuple, tables.last_wins(last, ["k"], "seq").collect())) == sorted(map(tuple, last.collect()))
    done = spark.createDataFrame([(1, "b"), (2, "x")], "k int, v string")
    assert [r.k for r in tables.changed(last.select("k", "v"), done, "k", "v").collect()] == [2]
    assert tables.pending(last, done, ["k"]).count() == 0


def test_name_match_prefers_equal_then_longest(spark):
    a = spark.createDataFrame([(1, "State  University"), (2, "The North State University of X"), (3, "college"), (4, "")], "a int, x string")
    b = spark.createDataFrame([(10, "state university"), (11, "North State University"), (12, "City College West"), (13, "")], "b int, y string")
    got = {r.a: (r.b, r.kind) for r in joins.name_match(a, b, "a", "x", "b", "y").collect()}
    assert got == {1: (10, "equal"), 2: (11, "contained"), 3: (12, "contained"), 4: (13, "equal")}


def test_greedy_dedupe(spark):
    rows = spark.createDataFrame([("o", x) for x in ("a b c", "c b a", "a b c d", "x y", "x y z w", "A-B-C")], "o string, l string")
    assert sorted(r.l for r in dedupe.greedy_near_duplicates(rows, "o", "l").collect()) == ["A-B-C", "x y", "x y z w"]


def test_greedy_dedupe_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("pq"), " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7)))) for _ in range(160)] + [("p", "--"), ("p", "!"), ("q", None)]
    want = set()
    for owner in "pq":
        kept = []
        for label in sorted({x for o, x in rows if o == owner and x is not None}, key=lambda x: (len(x), x)):
            own = set(re.findall("[a-z0-9]+", label.lower()))
            if not any(s == own or (min(len(s), len(own)) >= 3 and len(s & own) >= 0.8 * min(len(s), len(own))) for _, s in kept):
                kept.append((label, own))
        want |= {(owner, x) for x, _ in kept}
    got = dedupe.greedy_near_duplicates(spark.createDataFrame(rows, "o string, l string"), "o", "l").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_token_joins_by_brute_force(spark):
    rng = random.Random(6)
    name = lambda n: " ".join(rng.choice("red blue hot cold gear bolt nut ring".split()) + rng.choice(["", "1"]) for _ in range(n))
    qs, ns = [(i, name(rng.randrange(1, 6))) for i in range(40)], [(i, name(rng.randrange(1, 9))) for i in range(80)]
    toks = lambda x: set(x.split())
    want = {}
    for q, x in qs:
        scored = [(-len(toks(x) & toks(y)) / len(toks(x)), len(y), n) for n, y in ns if len(toks(x) & toks(y)) / len(toks(x)) >= 0.75]
        if scored:
            want[q] = (min(scored)[2], pytest.approx(-min(scored)[0]))
    a, b = spark.createDataFrame(qs, "q int, x string"), spark.createDataFrame(ns, "n int, y string")
    assert {r.q: (r.n, r.score) for r in joins.best_token_match(a, b, "q", "x", "n", "y").collect()} == want
    held = joins.named_in_text(b, spark.createDataFrame([("Hot gear",), ("ring",), ("",), ("bolt1 nut",)], "w string"), F.col("y"), "w")
    assert {(r.n, r.w) for r in held.select("n", "w").collect()} == {(n, w) for n, y in ns for w in ("Hot gear", "ring", "bolt1 nut") if f" {w.lower()} " in f" {y} "}


@pytest.fixture(scope="module")
def catalog_tables(spark):
    f = spark.createDataFrame([(i, f"n{i}", "S" if i < 6 else "T", i != 3, 40.0 + i if i != 5 else None, -90.0) for i in range(8)], "code int, name string, state string, approved boolean, lat double, lon double")
    texts = [(0, "pilot flight school"), (1, "pilot"), (2, "flight"), (3, "pilot flight"), (4, "diversity"), (4, "diver equity studies"), (5, "pilot flight"), (6, "auto mechanic"), (7, "automotive shop"), (7, "auto"), (2, "BSN nursing"), (2, "BS marketing"), (1, "firefighter academy"), (0, "emergency medical services"), (4, "used car sales")]
    return spark.createDataFrame([(c, "t", x) for c, x in texts], "code int, ptype string, description string"), f


def test_search_tiers(spark, catalog_tables):
    p, f = catalog_tables
    codes = lambda *a, **k: [r.code for r in program_search(p, f, Spec(*a, **k)).collect()]
    assert codes(["pilot", "flight"]) == [5, 0]  # the shorter text ranks higher
    assert set(codes(["pilot", "zebra"])) == {0, 1, 5}
    assert codes(["diver"]) == [4] and matching(p, Spec(["diver"], lexicon=Lexicon(markers={"div": ["equity"]})), True).count() == 0
    assert codes(["care"]) == []  # not a car
    other = p.where("code = 4 and description = 'diversity'").select("description", F.lit(0.7).alias("score"))
    assert [r.code for r in program_search(p, f, Spec(["zebra"]), other).collect()] == [4]
    assert set(codes(["pilot"], markers=["School"])) == {1, 5}


def test_place_is_settled_before_the_tier(spark, catalog_tables):
    p, f = catalog_tables
    near = program_search(p, f, Spec(["auto", "mechanic"], at=(47.0, -90.0), miles=30.0)).collect()
    assert [(r.code, r.hits, r.n_programs) for r in near] == [(7, 1, 1)]  # the strict match at 6 is too far
    far = program_search(p, f, Spec(["auto", "mechanic"], at=(47.0, -90.0), miles=100.0)).collect()
    assert [r.code for r in far] == [6]
    assert [r.code for r in program_search(p, f, Spec(["pilot"], at=(40.0, -90.0))).collect()] == [0, 1]  # 5 has no coordinates
    assert [r.code for r in program_search(p, f, Spec(["auto"], state="t")).collect()] == [7, 6]


def test_lexicon_of_a_search(spark, catalog_tables):
    p, f = catalog_tables
    lex = Lexicon(stop=frozenset({"school"}), exact=frozenset({"bs"}), phrases={"emt": "emergency medical"}, swaps={"pilot": ["flight"]}, wrong=((1, "pilot"),))
    found = lambda words, **k: [(r.code, r.description) for r in matching(p, Spec.of(words, lex, **k), True).select("code", "description").collect()]
    assert found("the bs school") == [(2, "BS marketing")] or Spec.of("the bs school", lex).terms == ["the", "bs"]
    assert found("bs") == [(2, "BS marketing")]
    assert found("EMT") == [(0, "emergency medical services")]
    assert sorted(found("pilot")) == [(0, "pilot flight school"), (2, "flight"), (3, "pilot flight"), (5, "pilot flight")]
    assert found("fire fighter") == [(1, "firefighter academy")]


def test_pages_of_a_search(spark):
    f = spark.createDataFrame([(i, f"n{i}", "S", True, 40.0, -90.0) for i in range(160)], "code int, name string, state string, approved boolean, lat double, lon double")
    p = spark.createDataFrame([(i, "t", f"weld {k}") for i in range(160) for k in range(1 + i % 9)], "code int, ptype string, description string")
    first = program_search(p, f, Spec(["weld"])).collect()
    second = program_search(p, f, Spec(["weld"], offset=100)).collect()
    assert (len(first), first[0].remaining, len(second), second[0].remaining) == (100, 60, 50, 10)
    assert {r.total_facilities for r in first + second} == {160} and {r.total_programs for r in first} == {p.count()}
    assert all(len(r.programs) == min(6, r.n_programs) for r in first)


def test_stemmed_search_and_index_that_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Łódź straße naïve"), (2, "Привет мир"), (3, "学校"), (4, "ending endings"), (5, None)], "id int, t string")
    ix = fulltext.write_index(rows, "id", ["t"], str(tmp_path), stemmed=False)
    assert {r.id for r in ix.matches([["łodz"]]).collect()} == {1} and {r.id for r in ix.matches([["naive"]]).collect()} == {1} and {r.id for r in ix.matches([["straß"]]).collect()} == {1}
    assert {r.id for r in ix.matches([["привет"]]).collect()} == {2} and {r.id for r in ix.matches([["学校"]]).collect()} == {3}
    again = fulltext.read_index(spark, "id", str(tmp_path), stemmed=False)
    assert "PushedFilters: [IsNotNull(token), StringStartsWith(token,end)]" in plan(again.bm25([["end"]])) or "StringStartsWith(token,end)" in plan(again.bm25([["end"]]))
    stems = fulltext.postings(rows, "id", ["t"], stemmed=True)
    assert {(r.id, r.tf) for r in stems.where("token = 'end'").collect()} == {(4, 2)}


def test_places(spark):
    f = spark.createDataFrame([(1, "springfield", "IL", "62701", 39.8, -89.6), (2, "springfield", "MA", "01101", 42.1, -72.6), (3, "west springfield", "MA", "01089", 42.2, -72.7), (4, "boston", "MA", "02108", None, None), (5, "boston", "MA", "02108", 42.3, -71.0), (6, "mesa", "ME", "x", 44.0, -69.0)], "code int, city string, state string, zip string, lat double, lon double")
    z = spark.createDataFrame([("02108", 42.36, -71.06), ("62701", 39.9, -89.7)], "zip string, lat double, lon double")
    states = {"illinois": "IL", "massachusetts": "MA", "maine": "ME"}
    find = lambda words: [(r.label, r.city, r.state, r.lat) for r in resolve_area(words, f, z, states).collect()]
    assert find("near Boston please") == [("Boston, MA", "boston", "MA", 42.36)]
    assert find("Springfield") == []  # of two states
    assert find("springfield, il") == [("Springfield, IL", "springfield", "IL", 39.9)]
    assert find("schools in West Springfield Massachusetts") == [("West Springfield, MA", "west springfield", "MA", pytest.approx(42.2))]
    assert find("West Springfield MA") == [("West Springfield, MA", "west springfield", "MA", pytest.approx(42.2))]
    assert find("in Illinois") == [("IL", None, "IL", pytest.approx(39.8))] and find("ma")[0][0] == "MA"
    assert find("help, me") == [] and find("tell me") == [] and find("nowhere") == []
    assert [(r.state, r.n) for r in candidates("springfield", f).collect()] == [("IL", 1), ("MA", 1)]


def test_what_messages_ask_for(spark):
    got = lambda c: one(spark, c)
    assert got(intent.names_program(F.lit("Welding certificates near me"))) and not got(intent.names_program(F.lit("What career has certificates")))
    assert not got(intent.names_program(F.lit("a school"), F.lit("11-1011"))) and not got(intent.names_program(F.lit(None).cast("string")))
    assert got(intent.nationwide(F.lit("show me all diver programs in usa"))) and got(intent.nationwide(F.lit("Nation wide"))) and not got(intent.nationwide(F.lit("show us all")))
    assert [got(intent.topic(F.lit(x))) for x in ("What kind of work?", "your ZIP code", "GI Bill", "a degree", "hm", None)] == ["interests", "location", "benefits", "training", "general", "general"]
    note = lambda text, after="p": got(intent.retained(F.array(F.lit("old")), F.lit(text), F.lit("p"), F.lit(after)))
    assert note(" I'd like it ") == ["old", "I'd like it"] and note("they like it") == ["old"] and note("I do", "q") == ["old"] and len(note("my " + "x" * 900)[1]) == 240
    turn = got(intent.overridden(F.array(F.lit("A")), F.array(F.lit("s")), F.lit("new"), F.lit("saved")))
    assert (turn.suggestions, turn.location) == (["A"], "saved")
    assert got(intent.overridden(F.lit(None).cast("array<string>"), F.array(F.lit("s")), F.lit("new"), F.lit("saved"))).location == "new"


def test_own_sites_and_apply_pages(spark):
    found = spark.createDataFrame([(1, "Acme Welding Institute", u, i) for i, u in enumerate(["https://acme-news.com", "https://www.facebook.com/acme", "https://acme.com/x", "https://www.acmeweld.edu"])] + [(2, "The College", "https://college.edu", 0), (3, "Zed Academy", "https://other.org", 0)], "k int, name string, url string, pos int")
    blocked = spark.createDataFrame([("facebook.com",)], "host string")
    assert [tuple(r) for r in web.own_site(found, "k", "name", "url", "pos", blocked, "news").collect()] == [(1, "https://www.acmeweld.edu")]

    def ok(status=200, final="https://x.edu/apply", asked="https://www.x.edu", title="Apply now", body="page", probe=(404, "")):
        c = F.lit
        return one(spark, web.apply_page(c(status), c(final), c(asked), c(title), F.array(c("text")), c(body), c(probe[0]), c(probe[1])))

    assert ok() and ok(final="https://apply.x.edu/start") and ok(probe=(200, "other"))
    assert not ok(status=404) and not ok(final="https://x.edu/") and not ok(final="https://y.edu/apply") and not ok(title="Jobs: apply, we are hiring") and not ok(title="Hello", final="https://x.edu/a") and not ok(probe=(200, "page"))
    html = '<a href="#">Apply Today</a><a href="/careers/apply">Apply</a><a href="https://else.com/apply">Apply</a><a href="/visit">Admissions</a><a href="/go">How to apply</a>'
    pages = web.parsed(spark.createDataFrame([(1, "https://x.edu/", html)], "id int, url string, html string"), "html")
    assert [tuple(r) for r in web.admission_links(pages, "id").collect()] == [(1, "https://x.edu/go", "How to apply", 2)]


def test_text_rules(spark):
    assert one(spark, text.normalize(F.lit("  O'Neil, 2nd-Foo  "))) == "o neil 2nd foo"
    reply = "**Now** see http://x.y/z\n* item\n\n\n\nSchool website: https://a.b\nProgram info:\nend\nSuggestions: [1]"
    assert one(spark, text.clean_message(F.lit(reply))) == "Now see \n- item\n\nend"
    assert one(spark, text.first_present(F.lit(None), F.lit(""), F.lit("x"))) == ""
    assert one(spark, text.json_block(F.lit('ok ```json\n{"a": 1}\n``` bye'))) == '{"a": 1}'
    assert one(spark, text.json_block(F.lit('ok {x} {"message": {"b": 2}}'))) == '{"message": {"b": 2}}'
    assert one(spark, text.json_block(F.lit('{"a": 1'))) is None
    assert one(spark, text.json_block(F.lit("no"))) is None
    assert one(spark, text.same_site(F.lit("a.b.org"), F.lit("b.org"))) and not one(spark, text.same_site(F.lit("ab.org"), F.lit("b.org")))
    assert one(spark, text.percent_encode(F.lit("a b/é"))) == "a%20b%2F%C3%A9"
    assert one(spark, text.round_even(F.lit("2.5"))) == 2 and one(spark, text.number(F.lit("x"))) is None


def test_cosine_of_nothing_is_null(spark):
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, vector.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1)


def sheet(rows):
    def cell(i, j, v):
        return f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r) if v)}</row>' for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿code, name\n1, x \n2,\n".encode())
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x"), ("2", None)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("rows.txt", b"\xef\xbb\xbfZIP | LAT\n001|2.5\n002|\xff\n")
    assert [tuple(r) for r in files.zipped_text(spark, str(tmp_path / "b.zip"), ["ZIP", "LAT"], "|").collect()] == [("001", "2.5"), ("002", "�")]
    (tmp_path / "c.nt").write_text('<http://a> <http://p> <http://b> .\n# no\n<http://a> <http://t> "say \\"hi\\"\\n"@en .\n<http://a> <http://n> "5"^^<http://int> .\n')
    assert [tuple(r) for r in files.ntriples(spark, str(tmp_path / "c.nt")).collect()] == [("http://a", "http://p", "http://b", "iri"), ("http://a", "http://t", 'say "hi"\n', "literal"), ("http://a", "http://n", "5", "literal")]
    (tmp_path / "d.xlsx").write_bytes(sheet([("Code", "", "Name"), ("11.0101", "", "x"), ("bad", "", "y")]))
    got = files.xlsx(spark, str(tmp_path / "d.xlsx"), ["Name", "Code"]).where(F.col("Code").rlike(r"^\d\d\.\d{4}$"))
    assert [tuple(r) for r in got.collect()] == [("x", "11.0101")]
    with pytest.raises(Exception, match="lacks"):
        files.xlsx(spark, str(tmp_path / "d.xlsx"), ["Other"]).collect()
    assert files.column_number("A") == 0 and files.column_number("AA") == 26
    before = snapshots.fingerprint(spark.read.csv(str(tmp_path / "a.csv")))
    assert before == snapshots.fingerprint(spark.read.csv(str(tmp_path / "a.csv"))) != snapshots.fingerprint(spark.read.csv(str(tmp_path / "a.csv")), "2")
    assert files.optional(spark, str(tmp_path / "none.parquet"), "a int").count() == 0

    def fetch(k):
        if k == "2":
            raise OSError("down")
        return f"got {k}"

    rows = files.fetched(spark.createDataFrame([("1",), ("2",)], "k string"), "k", fetch, wait=0.0).collect()
    assert [tuple(r) for r in rows] == [("1", None, "got 1", None), ("2", None, None, "OSError: down")]

    def limited(k, kind):
        if k == "2":
            raise files.Later(0.25)
        if k == "3":
            raise files.Spent
        return k + kind

    def slept(seconds):
        with open(tmp_path / "slept", "a") as f:
            f.write(f"{seconds} ")

    keys = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "k string").coalesce(1)
    rows = files.fetched(keys, "k", limited, tries=2, kinds=["a", "b"], sleep=slept).collect()
    assert [(r.k + r.kind, r.payload or r.error) for r in rows] == [("1a", "1a"), ("1b", "1b"), ("2a", "Later: asked to come back later"), ("2b", "Later: asked to come back later"), ("3a", "Spent"), ("3b", "Spent"), ("4a", "Spent"), ("4b", "Spent")]
    assert (tmp_path / "slept").read_text() == "0.25 0.25 "
    (tmp_path / "e.nt").write_text('_:b1 <p> "a\\\\nb" .\n<s> <p> _:b2 .\n')
    assert [tuple(r) for r in files.ntriples(spark, str(tmp_path / "e.nt")).collect()] == [("_:b1", "p", "a\\nb", "literal"), ("s", "p", "_:b2", "blank")]


def test_pages(spark):
    html = '<html><head><title>My &amp; page</title><script>var t="</p>";</script></head><body><p>Hello <b>you</b></p><a href="/apply">  Apply\n now </a><a href="http://x.y/login">Login apply</a></body></html>'
    pages = web.parsed(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "html")
    got = {r.id: r.page for r in pages.collect()}
    assert got[1].title == "My & page" and got[1].text[:2] == ["Hello", "you"] and got[2].links == []
    assert [tuple(x) for x in got[1].links] == [("/apply", "Apply now"), ("http://x.y/login", "Login apply")]
    assert [tuple(r) for r in web.classified(pages, "id", ["apply"], ["login"]).collect()] == [(1, "/apply", "Apply now", 2)]
    assert one(spark, urls.resolved(F.lit("http://a.b/c/d"), F.lit("../e"))) == "http://a.b/e"


def test_graph_patterns_need_shared_variables(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    assert [tuple(r) for r in graph.match(t, [("?x", "p", "?y"), ("?y", "q", "?z")]).select("x", "z").collect()] == [("a", "c")]
    assert [tuple(r) for r in graph.optional(graph.pattern(t, "?x", "p", "?y"), t, ("?y", "none", "?z")).select("x", "z").collect()] == [("a", None)]
    with pytest.raises(ValueError):
        graph.match(t, [("?x", "p", "?y"), ("?u", "q", "?v")])


def test_engine(spark):
    from lodestone.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    e = Engine(Catalog(t.facility, t.program, t.zcta, t.triples, t.crosswalk, t.completions))
    assert e.call("program_search", terms=["blue"]).count() > 0
    assert e.call("nearby", lat=37.0, lon=-95.0, miles=5000.0, k=3).count() == 3
    name = t.facility.first().name
    assert e.find_facility(name=name).first().name == name
    assert e.related("n/3", "inRegion").count() > 0 and e.entity("n/3").count() == 1
    state = t.facility.first().state
    assert e.resolve_location(f"schools near {state.title()}, please").first().state is not None
    code = int(t.program.first().code)
    every, some, few = (e.details(code, ["blue"], mode=m).collect() for m in ("all", "relevant", "sample"))
    assert all(len(r.programs) == r.all for r in every) and all(len(r.programs) == r.matching for r in some) and all(len(r.programs) == min(6, r.all) for r in few)
    assert e.details(code, required=[every[0].programs[-1]], k=1).where(F.col("ptype") == every[0].ptype).first().programs == [every[0].programs[-1]]
    facts = spark.createDataFrame([("x", "p", "1"), ("x", "p", "2"), ("x", "q", "3")], "s string, p string, o string")
    assert Engine(Catalog(t.facility, t.program, t.zcta, facts, t.crosswalk, t.completions)).entity("x").first().facts == {"p": ["1", "2"], "q": ["3"]}
    assert e.search_entities(t.part, "p_partkey", ["p_name", "p_type"], ["blue"]).count() > 0
    soc = t.crosswalk.first().soc
    trained = e.call("local_training", soc=soc, lat=37.0, lon=-95.0, miles=5000.0).collect()
    assert trained and all(r.code == r.unitid for r in trained if r.kind == "equal")
    vectors = t.facility.select("code", F.array(F.lit(1.0), F.col("code").cast("double")).alias("embedding"))
    alike = e.facility_search(37.0, -95.0, 5000.0, vectors, [1.0, 0.0], least=-1.0, k=3).collect()
    assert [r.stage for r in alike] == ["alike"] * 3 and all(r.verified for r in alike)
    none = e.facility_search(37.0, -95.0, 5000.0, vectors, [1.0, 0.0], least=5.0, terms=["blue"]).collect()
    assert {r.stage for r in none} == {"school"}
    first = e.nearby(37.0, -95.0, 5000.0, 5)
    assert {r.code for r in e.nearby(37.0, -95.0, 5000.0, 50, among=first).collect()} == {r.code for r in first.collect()}
    assert e.stats().count() == 4
    for bad in (lambda: e.call("drop_tables"), lambda: e.call("nearby", lat=200.0, lon=0.0), lambda: e.call("program_search", terms=[]), lambda: e.call("entity", wrong=1)):
        with pytest.raises(RequestError):
            bad()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from lodestone.plans import catalog
    from lodestone.plans.tables import Tables

    sf = "/root/testdata/sf0.001"
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["geo_topk"](spark, sf))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan(catalog.QUERIES["scan_filter"](spark, sf))
    for name in ("program_search", "join_name_match", "best_token_match", "near_dup_pairs", "crosswalk_topk"):
        assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, sf))
    assert "BroadcastHashJoin" in plan(Tables(spark, sf).facility)


def test_streamed_cache(spark, tmp_path):
    from lodestone.streaming import cache

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-20 00:00:00")], "cache_key int, ts string").select("cache_key", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("cache_key int, ts timestamp").parquet(str(tmp_path / "in"))
    q = cache.activity(reads).writeStream.format("memory").queryName("activity").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.cache_key, r.reads) for r in spark.table("activity").collect()} == {(1, 2), (2, 1)}
