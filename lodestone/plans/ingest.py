"""Queries of sources and sinks: given tables are written in a format and read back by its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext, tables
from ..sources import files
from ..sources.scratch import folder
from ..sources.snapshots import Store, fingerprint
from .registry import query

C = F.col


@query("src_csv", "select cast(s_suppkey as varchar) as s_suppkey, s_name, s_nationkey from supplier")
def _(t):
    where = folder(t.spark, "csv")
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(where)
    return files.csv(t.spark, where).withColumn("s_nationkey", C("s_nationkey").try_cast("int"))


@query("src_psv", "select c_custkey, c_mktsegment from customer where c_custkey is not null")
def _(t):
    where = folder(t.spark, "psv")
    t.customer.select("c_custkey", "c_mktsegment").write.option("header", True).option("sep", "|").csv(where)
    return files.csv(t.spark, where, "c_custkey bigint, c_mktsegment string", sep="|")


@query("src_ntriples_file", "select s, p, o from (select * from triples union all select '_:b' || s[3:], 'note', 'say \"' || o || '\"' || chr(10) || chr(92) || 'next' from triples where p = 'title')", "triples")
def _(t):
    """Triples written as N-Triples lines and parsed again, with blank nodes and escapes."""
    where = folder(t.spark, "nt")
    notes = t.triples.where("p = 'title'").select(F.concat(F.lit("_:b"), F.expr("substr(s, 3)")).alias("s"), F.lit("note").alias("p"), F.concat(F.lit('say "'), "o", F.lit('"\n\\next')).alias("o"))
    rows = t.triples.unionByName(notes)
    iri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    escaped = C("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    obj = F.when(C("p").isin("title", "name", "note"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(iri(C("o")))
    rows.select(F.concat(iri(C("s")), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" ."))).write.text(where)
    return files.ntriples(t.spark, where).select("s", "p", "o")


@query("src_fingerprint", "select * from (values ('supplier', true, true, false, true), ('part', true, true, false, true)) v(name, same, versioned, after_change, rebuilt)")
def _(t):
    """A table's mark: the same while its files are, another for another version of what is made of it,
    another once a row has been added; and whether a store made from it was built anew for that."""
    out = []
    for name in ("supplier", "part"):
        where = folder(t.spark, "marked")
        source = getattr(t, name)
        source.write.parquet(where)
        seen = lambda w=where: t.spark.read.parquet(w)
        first, again, other = fingerprint(seen()), fingerprint(seen()), fingerprint(seen(), "2")
        store = Store(t.spark, folder(t.spark, "made"))
        built = [store.refreshed(fingerprint(seen()), lambda: {"rows": seen().groupBy().count()}) for _ in range(2)]
        source.limit(1).write.mode("append").parquet(where)
        built.append(store.refreshed(fingerprint(seen()), lambda: {"rows": seen().groupBy().count()}))
        grew = store.read().first()[0] == store.read(version=1).first()[0] + 1
        out.append((name, first == again, first != other, first == fingerprint(seen()), built == [True, False, True] and grew))
    return t.spark.createDataFrame(out, "name string, same boolean, versioned boolean, after_change boolean, rebuilt boolean")


@query("snapshot_upsert_expire", """with base as (select * from cache_log),
up as (select cache_key, created_at, accessed_at + interval 2 hour as accessed_at from cache_log where cache_key % 3 = 0 union all select cache_key + 100000, created_at, accessed_at from cache_log where cache_key % 5 = 0),
merged as (select * from (select * from base union all select * from up) where cache_key % 7 <> 0 qualify row_number() over (partition by cache_key order by accessed_at desc) = 1)
select cache_key, accessed_at, (select count(*) from base) as before from merged where epoch(timestamp '2024-06-01 00:00:00') - epoch(accessed_at) <= 14000000""", "cache_log")
def _(t):
    """A stored table through three versions: written, merged with upserts and deletes, expired; the
    first version is still there to be read."""
    store, log = Store(t.spark, folder(t.spark, "cache")), t.cache_log
    store.commit({"rows": log})
    later = log.where("cache_key % 3 = 0").withColumn("accessed_at", C("accessed_at") + F.expr("INTERVAL 2 HOURS"))
    new = log.where("cache_key % 5 = 0").withColumn("cache_key", C("cache_key") + 100000)
    store.merge(later.unionByName(new), ["cache_key"], "accessed_at", log.where("cache_key % 7 = 0").select("cache_key").unionByName(new.where("cache_key % 7 = 0").select("cache_key")))
    store.changed(lambda rows: tables.unexpired(rows, F.lit("2024-06-01 00:00:00").cast("timestamp"), 14_000_000, "accessed_at"))
    return store.read().select("cache_key", "accessed_at", F.lit(store.read(version=1).count()).alias("before"))


@query("snapshot_index_refresh", "select doc_id from documents where regexp_matches(lower(strip_accents(text)), '(^|[^\\p{L}\\p{N}])inin') union all select doc_id + 1000000 from documents where doc_id % 10 = 0 and regexp_matches(lower(strip_accents(text)), '(^|[^\\p{L}\\p{N}])inin')")
def _(t):
    """The index of a table that grows: after the change the same call reads a new version."""
    where = folder(t.spark, "texts")
    docs = t.documents.select("doc_id", "text")
    docs.write.parquet(where)
    find = lambda: fulltext.index_of(t.spark.read.parquet(where), "doc_id", ["text"], where).matches([["inin"]])
    before = find()
    docs.where("doc_id % 10 = 0").withColumn("doc_id", C("doc_id") + 1000000).write.mode("append").parquet(where)
    return before.unionByName(find()).distinct()


@query("src_rest", "select cast(code as varchar) as code, kind, case when code % 7 <> 0 then code end as payload_code, case when code % 7 = 0 then 'OSError: unreachable' end as error from facility, (values ('a'), ('b')) v(kind)", "facility")
def _(t):
    """Payloads by key and kind from a fetcher that is passed in; every seventh key fails and says so."""

    def fetch(key: str, kind: str) -> str:
        if int(key) % 7 == 0:
            raise OSError("unreachable")
        return f'{{"code": {key}, "kind": "{kind}"}}'

    got = files.fetched(t.facility.select("code"), "code", fetch, kinds=["a", "b"], wait=0.0)
    return got.select("code", "kind", F.get_json_object("payload", "$.code").cast("bigint").alias("payload_code"), "error")


@query("src_zipped", "select cast(s_suppkey as varchar) as s_suppkey, s_name || chr(233) as s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def _(t):
    """Delimited text in archives, with a byte-order mark, a line each."""
    where = folder(t.spark, "zip")
    rows = t.supplier.select("s_suppkey", F.concat("s_name", F.lit("é")).alias("s_name"), "s_nationkey")
    files.write_zipped(rows.repartition(3, "s_suppkey"), ["s_nationkey", "s_suppkey", "s_name"], where)
    return files.zipped_text(t.spark, where, ["s_suppkey", "s_name", "s_nationkey"])


@query("src_zipped_psv", "select cast(c_custkey as varchar) as c_custkey, c_name || chr(65533) as c_name from customer")
def _(t):
    """Columns by their header names, separated by bars; bytes that are not UTF-8 are replaced."""
    where = folder(t.spark, "psv")
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit("é")).alias("c_name"))
    files.write_zipped(rows, ["c_name", "c_custkey"], where, sep="|", member="data.txt", encode="latin-1")
    return files.zipped_text(t.spark, where, ["c_custkey", "c_name"], sep="|")


@query("src_xlsx_filtered", "select cast(s_suppkey as varchar) as code, s_name as name from supplier where regexp_matches(cast(s_suppkey as varchar), '^[0-9]*[02468]$')")
def _(t):
    """Sheets of workbooks, rows kept by a pattern."""
    where = folder(t.spark, "xlsx")
    files.write_sheets(t.supplier.select(C("s_name").alias("name"), C("s_suppkey").alias("code")).repartition(2, "code"), ["name", "code"], where)
    return files.xlsx(t.spark, where, ["code", "name"]).where(C("code").rlike("^[0-9]*[02468]$"))


@query("search_rank_name", "select code, name from facility where approved order by lower(name), code limit 100", "facility")
def _(t):
    return t.facility.where("approved").orderBy(F.lower("name"), "code").limit(100).select("code", "name")


@query("search_rank_programs", "select p.code, count(*) as n from program p join facility f on p.code = f.code where f.is_school group by p.code order by n desc, p.code limit 100", "program facility")
def _(t):
    schools = t.facility.where("is_school").select("code")
    return t.program.join(schools, "code").groupBy("code").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "code").limit(100)
