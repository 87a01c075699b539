"""Queries of the relational core: scans, filters, joins, aggregates, orders, set operations, upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, ranking, tables
from .registry import query

C = F.col

#: The moment that ages are measured from: queries never read the clock.
NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("scan_filter", "select p_partkey, p_name, p_size from part where p_size > 40")
def _(t):
    return t.part.where(C("p_size") > 40).select("p_partkey", "p_name", "p_size")


@query("scan_pages", "select page_id, url, cast(length(html) as bigint) as n from pages")
def _(t):
    return t.pages.select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("point_lookup", "select s_suppkey, s_name, s_acctbal from supplier where s_suppkey = 7")
def _(t):
    return t.supplier.where(C("s_suppkey") == 7).select("s_suppkey", "s_name", "s_acctbal")


@query("optional_table", "select code, name as url from facility where code % 2 = 0 union all select cast(p_partkey as bigint), p_name from part", "facility")
def _(t):
    """A table that may be absent: one that is there, and one that is not, which gives no rows."""
    from ..sources.files import optional
    from ..sources.scratch import folder

    there = folder(t.spark, "optional")
    t.part.select(C("p_partkey").cast("bigint").alias("code"), C("p_name").alias("url")).write.parquet(there)
    schema, rows = "code bigint, url string", t.facility.where(C("code") % 2 == 0).select("code", C("name").alias("url"))
    return rows.unionByName(optional(t.spark, there, schema)).unionByName(optional(t.spark, f"{there}-none", schema))


def dynamic(rows: DataFrame, employer: bool | None = None, state: str | None = None) -> DataFrame:
    """Approved and located rows, with a flag that is asked for, refused or ignored."""
    conds = [C("approved"), C("lat").isNotNull(), C("lon").isNotNull()]
    if employer is not None:
        conds.append(C("is_employer") == employer)
    if state:
        conds.append(C("state") == state.upper())
    return rows.where(reduce(lambda a, b: a & b, conds))


@query("filter_dynamic", "select code, name from facility where approved and lat is not null and lon is not null and not is_employer", "facility")
def _(t):
    return dynamic(t.facility, employer=False).select("code", "name")


@query("filter_or", "select code from facility where approved and (is_employer or is_school)", "facility")
def _(t):
    return t.facility.where(C("approved") & (C("is_employer") | C("is_school"))).select("code")


@query("filter_state", "select code, state from facility where approved and lat is not null and lon is not null and state = upper('Nation_20')", "facility")
def _(t):
    return dynamic(t.facility, state="Nation_20").select("code", "state")


SOCS = "(select cip, list(soc order by soc) as socs from crosswalk group by cip)"


def _socs(t):
    return t.crosswalk.groupBy("cip").agg(F.sort_array(F.collect_set("soc")).alias("socs"))


@query("multivalue_contains", f"select cip, cast(len(socs) as bigint) as n from {SOCS} where list_contains(socs, (select min(soc) from crosswalk))", "crosswalk")
def _(t):
    least = t.crosswalk.agg(F.min("soc").alias("want"))
    return _socs(t).join(F.broadcast(least), F.array_contains("socs", C("want"))).select("cip", F.size("socs").cast("bigint").alias("n"))


@query("prefix_filter", "select zip, lat from zcta where starts_with(zip, '12')", "zcta")
def _(t):
    return t.zcta.where(C("zip").startswith("12")).select("zip", "lat")


@query("glob_filter", "select c_custkey from customer where regexp_matches(c_name, '[0-9]{5}') and regexp_matches(cast(c_custkey as varchar), '^[0-9]{3}')")
def _(t):
    return t.customer.where(C("c_name").rlike("[0-9]{5}") & C("c_custkey").cast("string").rlike("^[0-9]{3}")).select("c_custkey")


@query("nocase_eq", "select code from facility where lower(state) = lower('nAtIoN_7')", "facility")
def _(t):
    return t.facility.where(F.lower("state") == F.lower(F.lit("nAtIoN_7"))).select("code")


@query("not_ilike", "select p_partkey from part where p_name not ilike '%RED%'")
def _(t):
    return t.part.where(~C("p_name").ilike("%RED%")).select("p_partkey")


@query("null_or_empty", "select code from facility where (lat is null or trim(zip) = '') and length(zip) = 5", "facility")
def _(t):
    return t.facility.where((C("lat").isNull() | (F.trim("zip") == "")) & (F.length("zip") == 5)).select("code")


@query("coalesce_nullif", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) as v from orders where coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) <> 'F'")
def _(t):
    v = F.coalesce(F.nullif(C("o_orderstatus"), F.lit("O")), C("o_orderpriority"))
    return t.orders.withColumn("v", v).where(C("v") != "F").select("o_orderkey", "v")


@query("semi_in_list", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    wanted = t.customer.where(C("c_mktsegment") == "BUILDING").select(C("c_custkey").alias("o_custkey"))
    return joins.keys_in(t.orders, wanted, "o_custkey").select("o_orderkey")


@query("anti_pair", "select p_partkey from part p where not exists (select 1 from crosswalk c where c.cip = p.p_brand and c.soc = p.p_type and c.soc like '%A%')", "crosswalk")
def _(t):
    pairs = t.crosswalk.where(C("soc").like("%A%")).select(C("cip").alias("p_brand"), C("soc").alias("p_type"))
    return joins.without_pairs(t.part, pairs, ["p_brand", "p_type"]).select("p_partkey")


@query("project_record", "select code, upper(name) as title, coalesce(approved, false) as approved, coalesce(is_employer, false) as employer, try_cast(zip as bigint) as zip_number, concat('https://example.org/', cast(code as varchar)) as url, round(lat, 1) as lat from facility", "facility")
def _(t):
    return t.facility.select(
        "code",
        F.upper("name").alias("title"),
        F.coalesce("approved", F.lit(False)).alias("approved"),
        F.coalesce("is_employer", F.lit(False)).alias("employer"),
        C("zip").try_cast("bigint").alias("zip_number"),
        F.concat(F.lit("https://example.org/"), C("code").cast("string")).alias("url"),
        F.round("lat", 1).alias("lat"),
    )


LABELS = {"O": "open", "F": "filled"}


@query("code_label", "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end as label from orders")
def _(t):
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(labels, C("o_orderstatus")), F.lit("other")).alias("label"))


@query("case_category", "select code, case when is_employer and approved then 'on the job' when is_employer then 'employer' when approved then 'school' else 'other' end as category from facility", "facility")
def _(t):
    cat = F.when(C("is_employer") & C("approved"), "on the job").when(C("is_employer"), "employer").when(C("approved"), "school").otherwise("other")
    return t.facility.select("code", cat.alias("category"))


@query("validity_filter", "select l_orderkey, l_linenumber, cast(l_quantity as int) as n from lineitem where l_orderkey is not null and try_cast(l_quantity as int) > 30")
def _(t):
    return t.lineitem.withColumn("n", C("l_quantity").try_cast("int")).where(C("l_orderkey").isNotNull() & (C("n") > 30)).select("l_orderkey", "l_linenumber", "n")


@query("static_table", "select o_orderpriority, cast(rank as int) as rank, count(*) as n from orders join (values ('1-URGENT', 1), ('2-HIGH', 2), ('5-LOW', 5)) as v(p, rank) on o_orderpriority = p group by all")
def _(t):
    ranks = t.spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("5-LOW", 5)], "o_orderpriority string, rank int")
    return t.orders.join(F.broadcast(ranks), "o_orderpriority").groupBy("o_orderpriority", "rank").agg(F.count("*").alias("n"))


@query("marker_exclude", "select code, description from program where not (contains(lower(description), 'red') or contains(lower(description), 'hot'))", "program")
def _(t):
    """Rules switched on by a query term: the markers that rule a description out."""
    rules = {"pilot": ["red", "hot"], "nurse": ["cold"]}
    active = F.array(*[F.lit(m) for term in ("pilot",) for m in rules[term]])
    return t.program.where(~F.exists(active, lambda m: F.contains(F.lower("description"), m))).select("code", "description")


# Joins


@query("join_inner", "select unitid, cip, awlevel, awards, name from completions join facility on unitid = code", "completions facility")
def _(t):
    return t.completions.join(t.facility.select("code", "name"), C("unitid") == C("code")).select("unitid", "cip", "awlevel", "awards", "name")


@query("join_left_default", "select distinct c.cip, coalesce(b.title, c.cip) as title from crosswalk c left join (select cip, min(soc) as title from crosswalk where soc like 'P%' group by cip) b on c.cip = b.cip", "crosswalk")
def _(t):
    titles = t.crosswalk.where(C("soc").like("P%")).groupBy("cip").agg(F.min("soc").alias("title"))
    return t.crosswalk.select("cip").distinct().join(titles, "cip", "left").select("cip", F.coalesce("title", "cip").alias("title"))


@query("join_anti", "select f.code, g.u as site from facility f left join (select code, 'https://' || lower(name) as u from facility where code % 4 <> 0) g on g.code = f.code left join (select code from facility where code % 3 = 0) d on d.code = f.code where g.u is not null and d.code is null", "facility")
def _(t):
    """Those with a site of their own and none to apply at: two left joins, and what the second lacks."""
    site = t.facility.where(C("code") % 4 != 0).select("code", F.concat(F.lit("https://"), F.lower("name")).alias("site"))
    done = t.facility.where(C("code") % 3 == 0).select("code", F.lit(True).alias("done"))
    rows = t.facility.select("code").join(site, "code", "left").join(done, "code", "left")
    return rows.where("site is not null and done is null").select("code", "site")


@query("search_join_facility", "select p.code, p.description, f.name from program p join facility f on p.code = f.code where f.approved and contains(p.description, 'blue')", "program facility")
def _(t):
    f = t.facility.where("approved").select("code", "name")
    return t.program.where(C("description").contains("blue")).join(f, "code").select("code", "description", "name")


@query("join_conditional_left", "select f.code, case when f.lat is null then z.lat else f.lat end as lat, z.zip is not null as guessed from facility f left join zcta z on f.lat is null and f.zip = z.zip", "facility zcta")
def _(t):
    """A guess is joined only where the own value is missing: rows that have one keep a null key."""
    f = t.facility.withColumn("k", F.when(C("lat").isNull(), C("zip")))
    z = t.zcta.select(C("zip").alias("k"), C("lat").alias("zlat"), F.lit(True).alias("hit"))
    return f.join(z, "k", "left").select("code", F.coalesce("lat", "zlat").alias("lat"), F.coalesce("hit", F.lit(False)).alias("guessed"))


@query("crosswalk_join", f"select unitid, awlevel, c.cip, array_to_string(socs, ',') as socs from completions c join {SOCS} x on c.cip = x.cip", "completions crosswalk")
def _(t):
    return t.completions.join(_socs(t), "cip").select("unitid", "awlevel", "cip", F.array_join("socs", ",").alias("socs"))


@query(
    "join_name_match",
    """with a as (select page_id as a, trim(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', ' ', 'g')) as x from pages),
b as (select n_nationkey as b, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) as y from nation union all select 100 + r_regionkey, trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')) from region union all select 200, 'example com' union all select 201, 'example'),
c as (select a, b, x = y as same, length(y) as l from a join b on x = y or (y <> '' and contains(' ' || x || ' ', ' ' || y || ' ')) or (x <> '' and contains(' ' || y || ' ', ' ' || x || ' ')))
select a as page_id, b as place, case when same then 'equal' else 'contained' end as kind from (select *, row_number() over (partition by a order by same desc, l desc, b) as k from c) where k = 1""",
)
def _(t):
    places = t.nation.select(C("n_nationkey").alias("place"), C("n_name").alias("name")).union(t.region.select(C("r_regionkey") + 100, "r_name"))
    places = places.union(t.spark.createDataFrame([(200, "example.com"), (201, "example")], "place int, name string"))
    urls = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("url"))
    return joins.name_match(urls, places, "page_id", "url", "place", "name")


@query(
    "best_token_match",
    """with q as (select p_partkey as q, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as qt from part where p_partkey % 20 = 0),
n as (select description as n, list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+')) as nt, length(description) as l from (select distinct description from program)),
s as (select q, n, l, cast(len(list_intersect(qt, nt)) as double) / len(qt) as score from q, n)
select q as p_partkey, n as description, score from (select *, row_number() over (partition by q order by score desc, l, n) as k from s where score >= 0.75) where k = 1""",
    "program",
)
def _(t):
    """The queries asked are those of every twentieth part, against all descriptions."""
    return joins.best_token_match(t.part.where(C("p_partkey") % 20 == 0), t.described, "p_partkey", "p_name", "description", "description")


@query(
    "find_name",
    """with q as (select p_partkey as q, case p_partkey % 4 when 0 then upper(p_name) when 1 then p_name || ' ' || lower(p_brand) when 2 then p_name || ' ' || left(lower(p_brand), 8) else p_name || ' unheard' end as x from part),
qn as (select q, x, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) as x2 from q), n as (select description as n, length(description) as l, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) as y from (select distinct description from program)),
s as (select q, n, l, x2 = y as same, contains(y, x2) as inside, cast(len(list_intersect(list_distinct(string_split(x2, ' ')), list_distinct(string_split(y, ' ')))) as double) / len(list_distinct(string_split(x2, ' '))) as score from qn, n),
k as (select *, row_number() over (partition by q order by same desc, score desc, l, n) as k from s where same or score >= 0.75 or (inside and score > 0))
select q as p_partkey, n as description, case when same then 'equal' when inside then 'contained' else 'share' end as kind, score from k where k = 1""",
    "program",
)
def _(t):
    """Every part's name in four forms, as asked by somebody: in capitals, whole, cut short, and with a
    word too many; against all descriptions."""
    form = F.when(C("p_partkey") % 4 == 0, F.upper("p_name")).when(C("p_partkey") % 4 == 1, F.concat_ws(" ", "p_name", F.lower("p_brand"))).when(C("p_partkey") % 4 == 2, F.concat_ws(" ", "p_name", F.left(F.lower("p_brand"), F.lit(8))))
    asked = t.part.select("p_partkey", form.otherwise(F.concat("p_name", F.lit(" unheard"))).alias("x"))
    return joins.find_name(asked, t.described, "p_partkey", "x", "description", "description")


@query("join_name_equal", "select s_suppkey as code, n.s_suppkey as other, 'equal' as kind from supplier s join (select s_suppkey, s_name from supplier) n using (s_suppkey)")
def _(t):
    """Names written in two ways meet as equals."""
    other = t.supplier.select(C("s_suppkey").alias("other"), F.lower(F.replace("s_name", F.lit("#"), F.lit(" - "))).alias("name"))
    return joins.name_match(t.supplier.select(C("s_suppkey").alias("code"), "s_name"), other, "code", "s_name", "other", "name")


@query("group_resources", """with r as (select page_id, url, case when page_id % 3 = 0 then '' when page_id % 3 = 1 then null else regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) end as host from pages),
g as (select host, min(page_id) as first, list(url order by page_id) as items from r where host <> '' group by host union all select null, page_id, [url] from r where coalesce(host, '') = '')
select cast(row_number() over (order by host is null, first) as int) as position, host, items from g""")
def _(t):
    """Addresses by group in the order of first appearance, then those without a group, one by one."""
    host = F.when(C("page_id") % 3 == 0, "").when(C("page_id") % 3 == 2, F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return ranking.grouped_with_rest(t.pages.select("page_id", "url", host.alias("host")), "host", ["page_id"], C("url"))


@query("text_contains_join", "select conv_id, turn, word from conversations, (values ('the'), ('and'), ('this')) v(word) where contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || word || ' ')")
def _(t):
    words = t.spark.createDataFrame([("the",), ("and",), ("this",)], "word string")
    return joins.named_in_text(t.conversations, words, C("text"), "word").select("conv_id", "turn", "word")


@query("override_merge", "select code, coalesce(z.lat, f.lat) as lat, coalesce(z.lon, f.lon) as lon from facility f left join zcta z on f.zip = z.zip", "facility zcta")
def _(t):
    return tables.override(t.facility.select("code", "zip", "lat", "lon"), t.zcta, ["zip"], ["lat", "lon"]).select("code", "lat", "lon")


@query("semi_verify", "select code, exists (select 1 from program p where p.code = f.code and contains(p.description, 'hot')) as verified from facility f", "facility program")
def _(t):
    return joins.verified(t.facility.select("code"), t.program, "code", C("description").contains("hot"))


# Aggregates


@query("agg_count", "select count(*) as n, count(lat) as located from facility", "facility")
def _(t):
    return t.facility.agg(F.count("*").alias("n"), F.count("lat").alias("located"))


@query("agg_distinct", "select distinct code, ptype from program", "program")
def _(t):
    return t.program.select("code", "ptype").distinct()


@query("agg_mode", "select substr(c_name, 10, 5) as z, count(*) as n from customer group by 1 order by n desc, z limit 1")
def _(t):
    return t.customer.groupBy(F.substring("c_name", 10, 5).alias("z")).agg(F.count("*").alias("n")).orderBy(C("n").desc(), "z").limit(1)


@query("agg_centroid", "select state, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from facility group by state", "facility")
def _(t):
    return t.facility.groupBy("state").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query("agg_candidates", "select country, state, count(*) as n from facility group by all order by n desc, country, state limit 6", "facility")
def _(t):
    return t.facility.groupBy("country", "state").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "country", "state").limit(6)


@query("agg_explode_count", f"select soc, count(*) as n from (select unnest(socs) as soc from completions c join {SOCS} x on c.cip = x.cip) group by soc", "completions crosswalk")
def _(t):
    return t.completions.join(_socs(t), "cip").select(F.explode("socs").alias("soc")).groupBy("soc").agg(F.count("*").alias("n"))


@query("agg_collect_set", f"select cip, array_to_string(socs, ';') as socs from {SOCS}", "crosswalk")
def _(t):
    return _socs(t).select("cip", F.array_join("socs", ";").alias("socs"))


@query("agg_collect_docs", "select p_brand, array_to_string(list(distinct p_name order by p_name), ' | ') as names, array_to_string(list(distinct p_type order by p_type), ' | ') as types from part group by p_brand")
def _(t):
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " | ")
    return t.part.groupBy("p_brand").agg(join("p_name").alias("names"), join("p_type").alias("types"))


@query("search_group", "select code, count(*) as n, min(description) as first, max(ptype) as last, cast(sum(case when contains(description, 'blue') then 1 else 0 end) as bigint) as blue from program group by code", "program")
def _(t):
    return t.program.groupBy("code").agg(F.count("*").alias("n"), F.min("description").alias("first"), F.max("ptype").alias("last"), F.count_if(C("description").contains("blue")).alias("blue"))


@query("search_totals", "select cast(sum(n) as bigint) as programs, count(*) as facilities from (select code, count(*) as n from program where contains(description, 'blue') group by code)", "program")
def _(t):
    return t.program.where(C("description").contains("blue")).groupBy("code").agg(F.count("*").alias("n")).agg(F.sum("n").alias("programs"), F.count("*").alias("facilities"))


@query("agg_category_map", "select code, cast(sum(case when starts_with(ptype, 'P') then 1 else 0 end) as bigint) as p, cast(sum(case when starts_with(ptype, 'S') then 1 else 0 end) as bigint) as s from program group by code", "program")
def _(t):
    kinds = t.program.groupBy("code", F.substring("ptype", 1, 1).alias("k")).agg(F.count("*").alias("n"))
    m = kinds.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("bigint"))
    return m.select("code", get("P").alias("p"), get("S").alias("s"))


@query("agg_argmin", "select c_mktsegment, arg_min(c_custkey, (c_acctbal, c_custkey)) as poorest, arg_max(c_custkey, (c_acctbal, c_custkey)) as richest from customer group by c_mktsegment")
def _(t):
    order = F.struct("c_acctbal", "c_custkey")
    return t.customer.groupBy("c_mktsegment").agg(F.min_by("c_custkey", order).alias("poorest"), F.max_by("c_custkey", order).alias("richest"))


@query("match_all_any", "select o_custkey, bool_and(o_orderstatus = 'O') as every, bool_or(o_orderstatus = 'O') as some from orders group by o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_and(C("o_orderstatus") == "O").alias("every"), F.bool_or(C("o_orderstatus") == "O").alias("some"))


@query("array_first_match", "select cip, coalesce(list_filter(socs, lambda x: contains(x, 'E'))[1], socs[1]) as first from " + SOCS, "crosswalk")
def _(t):
    hit = F.get(F.filter("socs", lambda x: x.contains("E")), F.lit(0))
    return _socs(t).select("cip", F.coalesce(hit, F.get("socs", F.lit(0))).alias("first"))


# Orders, limits, set operations


@query("paginate", "select code, name, (select count(*) from facility) as total, greatest(0, (select count(*) from facility) - 30) as remaining from facility order by name, code limit 10 offset 20", "facility")
def _(t):
    return ranking.page(t.facility.select("code", "name"), ["name", "code"], 20, 10)


@query("topn_per_group", "select code, n, array_to_string(list(description order by description), '|') as first from (select code, description, count(*) over (partition by code) as n, row_number() over (partition by code order by description, ptype) as k from program) where k <= 6 group by code, n", "program")
def _(t):
    top = ranking.top_in_groups(t.program, ["code"], F.struct("description", "ptype"), 6)
    return top.select("code", "n", F.array_join(F.transform("first", lambda x: x["description"]), "|").alias("first"))


@query("rank_stable", "select doc_id, pos, word from (select *, row_number() over (partition by doc_id order by length(word) desc, pos) as k from (select doc_id, unnest(range(0, len(ws))) as pos, unnest(ws) as word from (select doc_id, string_split(text, ' ') as ws from documents))) where k <= 3")
def _(t):
    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return joins.numbered(words, ["doc_id"], [F.length("word").desc(), "pos"]).where(C("rank") <= 3).select("doc_id", C("pos").cast("bigint").alias("pos"), "word")


@query("rank_prefix_hits", "select p_partkey, cast(len(list_filter(['blue', 'cold', 'widget'], lambda q: len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, substr(q, 1, 4)))) > 0)) as int) as hits from part order by hits desc, p_partkey limit 6")
def _(t):
    terms = F.array(*[F.lit(x[:4]) for x in ("blue", "cold", "widget")])
    words = F.split("p_name", " ")
    hits = F.size(F.filter(terms, lambda q: F.exists(words, lambda w: F.startswith(w, q))))
    return ranking.top(t.part.select("p_partkey", hits.alias("hits")), [C("hits").desc(), "p_partkey"], 6)


@query("rank_longest_label", "select n_name, n_regionkey from nation order by length(n_name) desc, n_regionkey desc, n_name limit 10")
def _(t):
    return ranking.top(t.nation.select("n_name", "n_regionkey"), [F.length("n_name").desc(), C("n_regionkey").desc(), "n_name"], 10)


@query("tiered_fill", "select code, tier from (select code, min(tier) as tier from (select code, 0 as tier from facility where is_employer and approved union all select code, 1 from facility where approved union all select code, 2 from facility) group by code) order by tier, code limit 50", "facility")
def _(t):
    f = t.facility
    return ranking.tiered([f.where("is_employer and approved").select("code"), f.where("approved").select("code"), f.select("code")], "code", [], 50)


@query("union_distinct_nocase", "select label from (select label, row_number() over (partition by lower(label) order by src, label) as k, src from (select 0 as src, n_name as label from nation union all select 1, lower(n_name) from nation union all select 2, r_name from region)) where k = 1")
def _(t):
    rows = t.nation.select(F.lit(0).alias("src"), C("n_name").alias("label")).union(t.nation.select(F.lit(1), F.lower("n_name"))).union(t.region.select(F.lit(2), "r_name"))
    return ranking.distinct_by(rows, F.lower("label"), ["src", "label"]).select("label")


@query("expand_terms", "select p_name, list_sort(list_distinct(list_concat(string_split(p_name, ' '), case when contains(p_name, 'cold') then ['chill', 'ice'] else [] end))) as terms from (select distinct p_name from part)")
def _(t):
    related = t.spark.createDataFrame([("cold", ["chill", "ice"])], "term string, more array<string>")
    rows = t.part.select("p_name").distinct().withColumn("term", F.explode(F.split("p_name", " ")))
    rows = rows.join(F.broadcast(related), "term", "left").groupBy("p_name").agg(F.array_union(F.collect_set("term"), F.flatten(F.collect_list("more"))).alias("terms"))
    return rows.select("p_name", F.sort_array(F.array_distinct("terms")).alias("terms"))


@query("dedupe_pairs", "select l_partkey, l_suppkey, min(l_orderkey) as first from lineitem group by all")
def _(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first"))


@query("pinned_topn", "select o_custkey, o_orderkey, slot from (select *, cast(row_number() over (partition by o_custkey order by (o_orderstatus = 'F') desc, o_totalprice desc, o_orderkey) as int) as slot from orders) where slot <= 6")
def _(t):
    rows = t.orders.withColumn("must", C("o_orderstatus") == "F")
    return ranking.pinned(rows, ["o_custkey"], "must", "o_totalprice", "o_orderkey", 6).select("o_custkey", "o_orderkey", "slot")


@query("array_move_end", "select cip, list_append(list_filter(socs, lambda x: lower(x) <> lower(socs[1])), socs[1]) as socs from " + SOCS, "crosswalk")
def _(t):
    v = F.get("socs", F.lit(0))
    return _socs(t).select("cip", F.array_append(F.filter("socs", lambda x: F.lower(x) != F.lower(v)), v).alias("socs"))


# Table upkeep


@query("upsert_last_wins", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def _(t):
    return tables.last_wins(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("dedupe_first_wins", "select user_id, event_type, min(event_id) as event_id from events group by all")
def _(t):
    return tables.first_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("incremental_anti", "select code from facility where code not in (select code from facility where code % 3 = 0)", "facility")
def _(t):
    return tables.pending(t.facility.select("code"), t.facility.where(C("code") % 3 == 0), ["code"])


@query("incremental_changed", "select f.code, f.zip from facility f left join (select code, case when code % 2 = 0 then zip else '00000' end as zip from facility where code % 3 <> 0) d on f.code = d.code where d.code is null or f.zip is distinct from d.zip", "facility")
def _(t):
    done = t.facility.where(C("code") % 3 != 0).select("code", F.when(C("code") % 2 == 0, C("zip")).otherwise("00000").alias("zip"))
    return tables.changed(t.facility.select("code", "zip"), done, "code", "zip")


@query("cache_ttl", f"select cache_key from cache_log where epoch(timestamp '{NOW}') - epoch(created_at) <= 14000000", "cache_log")
def _(t):
    return tables.unexpired(t.cache_log, now(), 14_000_000).select("cache_key")


@query("cache_lru", "select cache_key, accessed_at from cache_log order by accessed_at desc, cache_key limit 25", "cache_log")
def _(t):
    return tables.most_recent(t.cache_log, 25).select("cache_key", "accessed_at")


@query("cache_touch", "select user_id as cache_key, min(ts) as created_at, max(ts) as accessed_at from events group by user_id")
def _(t):
    born = t.events.groupBy(C("user_id").alias("cache_key")).agg(F.min("ts").alias("created_at")).withColumn("accessed_at", C("created_at"))
    return tables.touched(born, t.events.select(C("user_id").alias("cache_key"), "ts"))


@query("ttl_fresh", f"select cache_key, case when epoch(timestamp '{NOW}') - epoch(accessed_at) <= 604800 then 'fresh' else 'stale' end as state from cache_log", "cache_log")
def _(t):
    log = t.cache_log
    return tables.fresh_or_stale(log.select("cache_key"), log.select("cache_key", C("accessed_at").alias("fetched_at")), "cache_key", now(), 604_800).select("cache_key", "state")


@query("upsert_null_sequence", "select user_id, event_id, value from (select user_id, event_id, value, case when event_id % 3 = 0 then null else ts end as seq from events) qualify row_number() over (partition by user_id order by seq desc nulls last, event_id desc) = 1")
def _(t):
    """A row without a sequence wins only where there is no other; sequences need not be numbers."""
    rows = t.events.select("user_id", "event_id", "value", F.when(C("event_id") % 3 != 0, C("ts")).alias("seq"))
    return tables.last_wins(rows, ["user_id"], "seq", ["event_id"]).drop("seq")
