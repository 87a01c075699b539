"""Queries of text and scalar functions, full-text search, vectors, geography, graphs and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import places
from ..functions import geo, intent, text, vector
from ..operators import fulltext, graph, joins, located, ranking, similar
from ..search import ORDERS, Spec, program_index, program_pages, program_search, semantic_programs
from .registry import query

C = F.col
T1 = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query("normalize", f"select conv_id, turn, array_to_string({T1.format('text')}, ' ') as x from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.normalize(C("text")).alias("x"))


@query("token_overlap", f"select conv_id, turn, round(cast(len(list_intersect(list_distinct({T1.format('text')}), ['the', 'and', 'this', 'zzz'])) as double) / 4, 6) as share from conversations")
def _(t):
    q = F.array(*map(F.lit, ("the", "and", "this", "zzz")))
    return t.conversations.select("conv_id", "turn", F.round(text.overlap(q, text.tokens(C("text"))), 6).alias("share"))


@query("try_number", "select c_custkey, try_cast(substr(c_name, 10) as double) as n, try_cast(c_mktsegment as double) as bad from customer")
def _(t):
    return t.customer.select("c_custkey", text.number(F.expr("substr(c_name, 10)")).alias("n"), text.number(C("c_mktsegment")).alias("bad"))


@query("round_even", "select l_orderkey, l_linenumber, cast(round_even(l_quantity / 2, 0) as bigint) as n from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(C("l_quantity") / 2).cast("bigint").alias("n"))


@query("format_address", "select code, concat_ws(', ', nullif(trim(name), ''), nullif(trim(state), ''), nullif(trim(case when code % 2 = 0 then '' else zip end), '')) as address from facility", "facility")
def _(t):
    return t.facility.select("code", text.address(C("name"), C("state"), F.when(C("code") % 2 == 0, "").otherwise(C("zip"))).alias("address"))


@query("title_case", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as title from part")
def _(t):
    return t.part.select("p_partkey", F.initcap("p_name").alias("title"))


@query("string_basic", "select n_nationkey, substr(n_name, 2, 3) as s, lower(n_name) as l, trim(n_name || ' ') as t, n_name || '/' || n_regionkey as c from nation")
def _(t):
    return t.nation.select("n_nationkey", F.substring("n_name", 2, 3).alias("s"), F.lower("n_name").alias("l"), F.trim(F.concat("n_name", F.lit(" "))).alias("t"), F.concat("n_name", F.lit("/"), C("n_regionkey").cast("string")).alias("c"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query("same_site", f"select page_id, {HOST} as host, {HOST} = 'example.com' or ends_with({HOST}, '.example.com') as ours from pages")
def _(t):
    h = text.host(C("url"))
    return t.pages.select("page_id", h.alias("host"), text.same_site(h, F.lit("example.com")).alias("ours"))


@query("scheme_default", "select page_id, case when not regexp_matches(u, '^https?://') then 'https://' || u else u end as url from (select page_id, case when page_id % 2 = 0 then regexp_replace(url, '^https?://', '') else url end as u from pages)")
def _(t):
    u = F.when(C("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(C("url"))
    return t.pages.select("page_id", text.with_scheme(u).alias("url"))


@query("url_encode", "select page_id, url_encode(url || ' a') as x from pages")
def _(t):
    return t.pages.select("page_id", text.percent_encode(F.concat("url", F.lit(" a"))).alias("x"))


LINES = "Program details|Program info|School website|Official Resources?"
CLEAN = [(r"\n\s*suggestions\s*:\s*\[.*\]\s*$", "", "is"), (rf"^[^\S\n]*(?:{LINES}):\s*https?://\S+[^\S\n]*$", "", "gim"), (r"https?://\S+", "", "g"), (rf"^[^\S\n]*(?:{LINES}):[^\S\n]*$", "", "gm"), (r"\n{3,}", "\n\n", "g"), (r"\*\*(.+?)\*\*", r"\1", "g"), (r"^[^\S\n]*[-*]\s+", "- ", "gm")]
#: A reply of every form that the cleaner knows, made of a given text.
REPLY = "'**Note:** ' || text || chr(10) || '* first  item' || chr(10) || chr(10) || chr(10) || chr(10) || 'School website: https://a.example/b' || chr(10) || 'see http://c.example/d?e now' || chr(10) || 'Program info:' || chr(10) || 'Suggestions: [\"x\", \"y\"] '"


def _cleaned(body: str) -> str:
    for pattern, to, flags in CLEAN:
        body = "regexp_replace({}, '{}', '{}', '{}')".format(body, pattern, to.replace("\n", "' || chr(10) || '"), flags.replace("m", ""))  if "m" not in flags else "regexp_replace({}, '(?m){}', '{}', '{}')".format(body, pattern, to, flags.replace("m", ""))
    return rf"regexp_replace(regexp_replace({body}, '^\s+', ''), '\s+$', '')"


@query("clean_text", f"select conv_id, turn, {_cleaned(REPLY)} as x from conversations")
def _(t):
    parts = [F.lit("**Note:** "), C("text"), F.lit("\n* first  item\n\n\n\nSchool website: https://a.example/b\nsee http://c.example/d?e now\nProgram info:\nSuggestions: [\"x\", \"y\"] ")]
    return t.conversations.select("conv_id", "turn", text.clean_message(F.concat(*parts)).alias("x"))


@query("json_extract", "select event_id, case event_id % 4 when 3 then null else '{\"message\": ' || props || '}' end as json from events")
def _(t):
    """Fenced, bare, at the end of other text, and broken: the last has none, and its text is used."""
    found = F.concat(F.lit('{"message": '), "props", F.lit("}"))
    k = C("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), found, F.lit("\n```"))).when(k == 1, F.concat(F.lit("  "), found)).when(k == 2, F.concat(F.lit("So {that} is "), found)).otherwise(F.concat(F.lit("none {"), "props"))
    return t.events.select("event_id", text.json_block(reply).alias("json"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


#: Each message asks for something of each kind in turn.
ASKS = {0: "which programs are there", 1: "what career fits me, and which schools", 2: "show all of it in the U.S. please", 3: "nation-wide", 4: "every day"}


def _asked(t):
    more = F.element_at(F.create_map(*[F.lit(x) for kv in ASKS.items() for x in kv]), (C("conv_id") + C("turn")) % 5)
    return t.conversations.select("conv_id", "turn", F.concat("text", F.lit(". "), more).alias("text"), F.when(C("turn") % 2 == 1, C("role")).alias("chosen"))


_RE2 = lambda p: p.replace("(?i)", "")
_ASKED = "select conv_id, turn, lower(text || '. ' || case cast((conv_id + turn) % 5 as int) " + " ".join(f"when {k} then '{v}'" for k, v in ASKS.items()) + " end) as m, case when turn % 2 = 1 then role end as chosen from conversations"


@query("intent_flags", f"select conv_id, turn, chosen is null and regexp_matches(m, '{_RE2(intent.PROGRAM)}') and not regexp_matches(m, '{_RE2(intent.EXPLORING)}') as named, regexp_matches(m, '{_RE2(intent.NATIONWIDE)}') or (regexp_matches(m, '{_RE2(intent.BROAD)}') and regexp_matches(m, '{_RE2(intent.COUNTRY)}')) as wide from ({_ASKED})")
def _(t):
    return _asked(t).select("conv_id", "turn", intent.names_program(C("text"), C("chosen")).alias("named"), intent.nationwide(C("text")).alias("wide"))


#: Replies on every topic in turn.
REPLIES = {0: "What kind of work suits you?", 1: "Your ZIP code, please.", 2: "Is any of your GI Bill left?", 3: "A certificate may do.", 4: "Well."}


@query("route_case", "select conv_id, turn, case " + " ".join(f"when regexp_matches(m, '{p}') then '{n}'" for n, p in intent.TOPICS) + " else 'general' end as route from (select conv_id, turn, lower(text || ' ' || case cast((conv_id + turn) % 5 as int) " + " ".join(f"when {k} then '{v}'" for k, v in REPLIES.items()) + " end) as m from conversations)")
def _(t):
    reply = F.concat("text", F.lit(" "), F.element_at(F.create_map(*[F.lit(x) for kv in REPLIES.items() for x in kv]), (C("conv_id") + C("turn")) % 5))
    return t.conversations.select("conv_id", "turn", intent.topic(reply).alias("route"))


@query("near_dup_pairs", f"""with n as (select p_brand, p_partkey as k, p_name || ' ' || p_type as l from part), d as (select p_brand, l, list_distinct({T1.format("l")}) as ts from (select distinct p_brand, l from n)),
p as (select a.p_brand as owner, a.l as a, b.l as b, len(list_intersect(a.ts, b.ts)) as i, least(len(a.ts), len(b.ts)) as m, len(a.ts) as x, len(b.ts) as y from d a join d b on a.p_brand = b.p_brand and (length(a.l) < length(b.l) or (length(a.l) = length(b.l) and a.l < b.l)))
select owner, a, b from p where (i = x and i = y) or (x >= 3 and y >= 3 and i >= 0.8 * m)""")
def _(t):
    """Distinct labels of a brand whose tokens are equal or nearly contained: a join on rare tokens."""
    from ..operators.dedupe import near_pairs

    labels = t.part.select(C("p_brand").alias("owner"), F.concat_ws(" ", "p_name", "p_type").alias("label")).distinct()
    return near_pairs(labels.withColumn("ts", F.array_distinct(text.tokens(C("label")))))


@query("cache_key", """select event_id, sha256('{"payload":{"a":{"m":' || user_id || ',"z":["x",null,true]},"k":' || regexp_extract(props, '[0-9]+', 0) || ',"t":"' || event_type || '\\u00e9"},"version":"v2"}') as key from events""")
def _(t):
    """Payloads written with keys in two orders, nested and spaced: one key of both, with a version."""
    k = F.get_json_object("props", "$.k")
    one = F.format_string('{"t" : "%sé", "k": %s,\n"a":{"z":["x", null, true], "m":%s}}', C("event_type"), k, C("user_id").cast("string"))
    two = F.format_string('{"a":{"m":%s,"z":["x",null,true]},"k":%s,"t":"%s\\u00e9"}', C("user_id").cast("string"), k, C("event_type"))
    return t.events.select("event_id", text.versioned_key(F.when(C("event_id") % 2 == 0, one).otherwise(two), "v2").alias("key"))


@query("retain_note", "select conv_id, turn, case when turn % 3 <> 0 and regexp_matches(m, '(?i)\\b(i|i''m|i''d|my|me)\\b') and trim(m) not in ('a', 'My note') then list_append(['a', 'My note'], trim(m)[1:240]) else ['a', 'My note'] end as notes from (select conv_id, turn, case cast(turn % 4 as int) when 1 then ' My goal: ' || text when 2 then 'My note' else text end as m from conversations)")
def _(t):
    """A note is kept where the profile is as before, the message in the first person and new."""
    m = F.when(C("turn") % 4 == 1, F.concat(F.lit(" My goal: "), "text")).when(C("turn") % 4 == 2, "My note").otherwise(C("text"))
    after = F.when(C("turn") % 3 != 0, "same").otherwise("other")
    return t.conversations.select("conv_id", "turn", intent.retained(F.array(F.lit("a"), F.lit("My note")), m, F.lit("same"), after).alias("notes"))


@query("autolink", """with label as materialized (select min(w) as label from (select distinct unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as w from benchmark) where length(w) > 4 group by lower(w)),
piece as (select conv_id, turn, generate_subscripts(ps, 1) as i, unnest(ps) as p from (select conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') as ps from conversations))
select conv_id, turn, string_agg(case when label is null then p else '[' || p || '](https://example.org/' || label || ')' end, '' order by i) as x from piece left join label on lower(p) = lower(label) group by conv_id, turn""")
def _(t):
    """The longer words of the benchmark, from a table, as links in all turns."""
    from ..operators.linking import autolinked

    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("w")).where(F.length("w") > 4)
    labels = words.groupBy(F.lower("w")).agg(F.min("w").alias("label")).select("label", F.concat(F.lit("https://example.org/"), "label").alias("url"))
    return autolinked(t.conversations.select("conv_id", "turn", C("text").alias("x")).where("x <> ''"), "x", labels, ["conv_id", "turn"])


@query("group_ordered", "select o_custkey, list(o_orderkey order by o_orderdate, o_orderkey) as orders from orders group by o_custkey")
def _(t):
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return rows.select("o_custkey", F.transform("x", lambda x: x["o_orderkey"]).alias("orders"))


@query("fmt_money", "select c_custkey, case when c_custkey % 7 = 0 then null else printf('$%.2f', c_acctbal) end as money from customer")
def _(t):
    return t.customer.select("c_custkey", F.when(C("c_custkey") % 7 != 0, F.format_string("$%.2f", "c_acctbal")).alias("money"))


SOCS = "(select cip, list(soc order by soc) as socs from crosswalk group by cip)"


def _socs(t):
    return t.crosswalk.groupBy("cip").agg(F.sort_array(F.collect_set("soc")).alias("socs"))


@query("array_toggle", f"select cip, case when list_contains(socs, 'ECONOMY BRASS') then list_filter(socs, lambda x: x <> 'ECONOMY BRASS') else list_append(socs, 'ECONOMY BRASS') end as socs from {SOCS}", "crosswalk")
def _(t):
    v = F.lit("ECONOMY BRASS")
    return _socs(t).select("cip", F.when(F.array_contains("socs", v), F.filter("socs", lambda x: x != v)).otherwise(F.array_append("socs", v)).alias("socs"))


@query("remainder_label", f"select cip, greatest(len(socs) - 6, 0) as more, case when greatest(len(socs) - 6, 0) = 1 then 'program' else 'programs' end as label from {SOCS}", "crosswalk")
def _(t):
    more = F.greatest(F.size("socs") - 6, F.lit(0)).cast("bigint")
    return _socs(t).select("cip", more.alias("more"), F.when(more == 1, "program").otherwise("programs").alias("label"))


@query("override_list", f"select cip, case when len(list_filter(socs, lambda x: contains(x, 'E'))) > 0 then list_filter(socs, lambda x: contains(x, 'E')) else ['none'] end as out, case when len(list_filter(socs, lambda x: contains(x, 'E'))) > 0 then 'saved' else cip end as location from {SOCS}", "crosswalk")
def _(t):
    turn = intent.overridden(F.filter("socs", lambda x: x.contains("E")), F.array(F.lit("none")), C("cip"), F.lit("saved"))
    return _socs(t).select("cip", turn.alias("t")).select("cip", C("t.suggestions").alias("out"), C("t.location").alias("location"))


@query("concat_context", "select cip, array_to_string(list_concat([cip], socs), ' ') as x from " + SOCS, "crosswalk")
def _(t):
    profile = F.create_map(F.lit("a"), F.array("cip"), F.lit("b"), C("socs"))
    return _socs(t).select("cip", F.array_join(F.flatten(F.map_values(profile)), " ").alias("x"))


@query("pick_best_url", f"""with f as (select regexp_extract(h, '[^.]+\\.[^.]+$', 0) as grp, h, url, page_id from (select page_id, url, {HOST} as h from pages)),
n as (select grp, page_id, url, h, 'The ' || substr(regexp_extract(h, '^(m\\.)?([^.]+)', 2), 1, 3) || ' Institute' as name from f),
ok as (select *, regexp_replace(h, '[^a-z0-9]', '', 'g') as letters, list_filter(list_distinct({T1.format('name')}), lambda w: length(w) > 2 and w not in ('the', 'institute')) as ws from n where h <> '' and not (h = 'example.net' or ends_with(h, '.example.net')) and not regexp_matches(h, 'news|^m\\.'))
select grp, url from (select *, row_number() over (partition by grp order by not ends_with(h, '.org'), page_id) as k from ok where len(list_filter(ws, lambda w: contains(letters, w))) > 0) where k = 1""")
def _(t):
    """The pages of a domain as what was found for a name: blocked hosts, name words, the ending."""
    from ..sources.web import own_site

    h = text.host(C("url"))
    name = F.concat(F.lit("The "), F.substring(F.regexp_extract(h, r"^(m\.)?([^.]+)", 2), 1, 3), F.lit(" Institute"))
    rows = t.pages.select("page_id", "url", F.regexp_extract(h, r"[^.]+\.[^.]+$", 0).alias("grp"), name.alias("name"))
    blocked = t.spark.createDataFrame([("example.net",)], "host string")
    return own_site(rows, "grp", "name", "url", "page_id", blocked, r"news|^m\.", ".org")


@query("soft404", f"""with a as (select page_id, url, html, page_id % 4 as k from pages), f as (select page_id, case when k = 0 then 404 else 200 end as status, case when k = 1 then 'https://' || h || '/' when k = 2 then 'https://other.example/apply' else 'https://' || h || '/apply' end as final, case when k = 3 and page_id % 8 = 7 then 'Jobs: hiring' else 'How to apply' end as title, html, k, h from (select *, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) as h from a)),
p as (select f.*, case when page_id % 3 = 0 then html else 'not here' end as probe from f)
select page_id, status < 400 and k not in (0, 1, 2) and title = 'How to apply' and substr(probe, 1, 2000) <> substr(html, 1, 2000) as ok from p""")
def _(t):
    """Pages as answers to a guessed path: lost, sent to the root, sent elsewhere, of jobs, and real ones."""
    from ..sources.web import apply_page

    k, h = C("page_id") % 4, F.regexp_extract(F.lower("url"), "^[a-z]+://([^/:?#]+)", 1)
    site = F.concat(F.lit("https://"), h)
    final = F.when(k == 1, F.concat(site, F.lit("/"))).when(k == 2, F.lit("https://other.example/apply")).otherwise(F.concat(site, F.lit("/apply")))
    title = F.when(C("page_id") % 8 == 7, "Jobs: hiring").otherwise("How to apply")
    probe = F.when(C("page_id") % 3 == 0, C("html")).otherwise(F.lit("not here"))
    return t.pages.select("page_id", apply_page(F.when(k == 0, 404).otherwise(200), final, C("url"), title, F.array(F.lit("text")), C("html"), F.lit(200), probe).alias("ok"))


@query("html_parse")
def _(t):
    from ..sources.web import parsed

    return parsed(t.pages, "html").select("page_id", "page.title", F.size("page.text").alias("runs"), F.size("page.links").alias("links"))


_LINK = """link as (select page_id, url as page, generate_subscripts(hs, 1) as pos, unnest(hs) as href, trim(regexp_replace(unnest(ls), '\\s+', ' ', 'g')) as label
  from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as ls from pages))"""
_EDGE = "(^|[^\\p{{L}}\\p{{N}}_])({})([^\\p{{L}}\\p{{N}}_]|$)"


@query("link_classify", f"""with {_LINK}, p as (select *, case when regexp_matches(lower(label), '{_EDGE.format('la|the')}') then 2 when regexp_matches(lower(href), '{_EDGE.format('la|the')}') then 1 else 0 end as priority from link where not regexp_matches(lower(href || ' ' || label), '{_EDGE.format('login')}'))
select page_id, href as url, label, priority from p where priority > 0 qualify row_number() over (partition by page_id order by priority desc, pos) = 1""")
def _(t):
    """The best link of each page by wanted and unwanted words."""
    from ..sources.web import classified, parsed

    return classified(parsed(t.pages, "html"), "page_id", ["la", "the"], ["login"])


@query("admission_links", f"""with {_LINK}, asked as (select page_id, page, pos, case when pos % 3 = 0 then '/apply/' || page_id when pos % 3 = 1 then 'http://jobs.example.com/apply' else 'admissions' end as href, label from link),
abs as (select *, regexp_extract(page, '^[a-z]+://[^/?#]*', 0) as site, regexp_replace(regexp_extract(page, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as dir from asked),
target as (select page_id, pos, label, case when href[1:1] = '/' then site || href when href[1:4] = 'http' then href else site || dir || href end as url, case when pos % 3 = 0 then 2 else 1 end as priority, site from abs where pos % 3 <> 1)
select page_id, url, case when label = '' then 'Apply' else label end as label, cast(priority as int) as priority from target qualify row_number() over (partition by page_id order by priority desc, pos) = 1""")
def _(t):
    """Links of pages made to point to admission pages of the site and to an employment page elsewhere."""
    from ..sources.web import admission_links, parsed

    to = lambda x, i: F.struct(F.when((i + 1) % 3 == 0, F.concat(F.lit("/apply/"), C("page_id").cast("string"))).when((i + 1) % 3 == 1, "http://jobs.example.com/apply").otherwise("admissions").alias("url"), x["label"].alias("label"))
    pages = parsed(t.pages, "html").withColumn("page", F.struct(F.transform("page.links", to).alias("links")))
    return admission_links(pages, "page_id")


@query("url_join", f"""with {_LINK}, base as (select page_id, href, regexp_extract(page, '^[a-z]+:', 0) as scheme, regexp_extract(page, '^[a-z]+://[^/?#]*', 0) as site, regexp_extract(page, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(page, '^[a-z]+://[^?#]*(\\?[^#]*)', 1) as q from link),
d as (select *, regexp_replace(path, '[^/]*$', '') as dir, regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') as up from base)
select page_id, href as link, site || href as target from d union all select page_id, '..' || href, site || up || href[2:] from d union all select page_id, '.' || href || '/x/../.', site || dir || href[2:] || '/' from d
union all select page_id, '?q=' || href, site || path || '?q=' || href from d union all select page_id, '#' || href, site || path || q || '#' || href from d union all select page_id, '//other.example/a/../b' || href, scheme || '//other.example/b' || href from d union all select page_id, '/../../' || href[2:], site || href from d""")
def _(t):
    """Every link of every page in seven forms, as seen from its page; no Python but the parser's."""
    from ..functions.urls import resolved
    from ..sources.web import parsed

    links = parsed(t.pages, "html").select("page_id", "url", F.explode("page.links.url").alias("l"))
    tail = F.expr("substr(l, 2)")
    forms = [C("l"), F.concat(F.lit(".."), "l"), F.concat(F.lit("."), "l", F.lit("/x/../.")), F.concat(F.lit("?q="), "l"), F.concat(F.lit("#"), "l"), F.concat(F.lit("//other.example/a/../b"), "l"), F.concat(F.lit("/../../"), tail)]
    return links.select("page_id", "url", F.explode(F.array(*forms)).alias("link")).select("page_id", "link", resolved(C("url"), C("link")).alias("target"))


@query("greedy_dedupe")
def _(t):
    from ..operators.dedupe import greedy_near_duplicates

    return greedy_near_duplicates(t.part.select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("label")), "p_brand", "label")


# Full text

WORDS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"
POST = f"""d as (select doc_id, unnest({WORDS.format("text")}) as token from documents),
posts as (select doc_id, token, count(*) as tf from d group by all), lens as (select doc_id, sum(tf) as len from posts group by doc_id)"""


def _texts(t, stemmed=False):
    """The index of all documents: written once, read by every search."""
    return fulltext.index_of(t.documents, "doc_id", ["text"], t.sf_dir, stemmed)


@query("fts_postings", f"with {POST} select doc_id, token, tf from posts")
def _(t):
    return fulltext.postings(t.documents, "doc_id", ["text"]).select("doc_id", "token", "tf")


@query("fts_index", f"with {POST} select token, count(*) as docs, cast(sum(tf) as bigint) as tf from posts group by token")
def _(t):
    """What the written index holds of each word."""
    return _texts(t).postings.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


def _parts(t):
    """The index of parts by two fields."""
    return fulltext.index_of(t.part, "p_partkey", ["p_name", "p_type"], t.sf_dir)


def _six(t):
    """Parts as records of six text fields."""
    sellers = t.lineitem.join(t.supplier, C("l_suppkey") == C("s_suppkey")).select(C("l_partkey").alias("p_partkey"), "s_name").distinct()
    sellers = sellers.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), " ").alias("sellers"))
    rows = t.part.join(sellers, "p_partkey", "left")
    return rows.select("p_partkey", C("p_name").alias("title"), C("p_type").alias("alternates"), C("p_brand").alias("description"), F.concat_ws(" ", "p_name", "p_type").alias("tasks"), C("p_size").cast("string").alias("features"), "sellers")


SIX = ["title", "alternates", "description", "tasks", "features", "sellers"]
_SIX = "(select p_partkey, p_name as title, p_type as alternates, p_brand as description, p_name || ' ' || p_type as tasks, cast(p_size as varchar) as features, s as sellers from part left join (select l_partkey, string_agg(s_name, ' ' order by s_name) as s from (select distinct l_partkey, s_name from lineitem join supplier on l_suppkey = s_suppkey) group by all) on p_partkey = l_partkey)"


@query("fts_postings_fields", " union all ".join(f"select p_partkey, '{f}' as field, token, count(*) as tf from (select p_partkey, unnest({WORDS.format(f)}) as token from {_SIX}) group by all" for f in SIX))
def _(t):
    return fulltext.postings(_six(t), "p_partkey", SIX)


def _leaf(i: int) -> str:
    return f"-greatest(ln((n - d{i} + 0.5e0) / (d{i} + 0.5e0)), 1e-6) * f{i} * 2.2e0 / (f{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl))"


_WEIGHTS = {"title": 12, "alternates": 9, "description": 3, "tasks": 5, "features": 2, "sellers": 2}


def _entity_sql(terms: list[str], k: int) -> str:
    weight = "case field " + " ".join(f"when '{f}' then {w}e0" for f, w in _WEIGHTS.items()) + " end"
    inside = "field in ('title', 'alternates')"
    at = list(enumerate(terms))
    sums = ", ".join(f"sum(case when starts_with(token, '{x}') and {inside} then tf * {weight} else 0 end) as mf{i}, sum(case when starts_with(token, '{x}') then tf * {weight} else 0 end) as f{i}" for i, x in at)
    seen = ", ".join(f"cast(count(*) filter (where mf{i} > 0) as double) as md{i}, cast(count(*) filter (where f{i} > 0) as double) as d{i}" for i, _ in at)
    main, every = (" + ".join(_leaf(i).replace(f"d{i}", f"{m}d{i}").replace(f"f{i}", f"{m}f{i}") for i, _ in at) for m in ("m", ""))
    tier = f"case when {' and '.join(f'mf{i} > 0' for i, _ in at)} then 0 when {' or '.join(f'mf{i} > 0' for i, _ in at)} then 1 else 2 end"
    posts = " union all ".join(f"select p_partkey, '{f}' as field, unnest({WORDS.format(f)}) as token from six" for f in SIX)
    return f"""with six as {_SIX}, posts as materialized (select p_partkey, field, token, count(*) as tf from ({posts}) group by all), lens as (select p_partkey, sum(tf) as len from posts group by all),
h as materialized (select p_partkey, {sums} from posts group by p_partkey), tot as (select count(*) as n, avg(len) as avgdl from lens), seen as (select {seen} from h),
s as (select p_partkey, {tier} as tier, round(case when {tier} < 2 then {main} else {every} end, 6) as score from h join lens using (p_partkey), tot, seen where {' or '.join(f'f{i} > 0' for i, _ in at)})
select p_partkey, cast(tier as int) as tier, score from s order by tier, score, p_partkey limit {k}"""


@query("entity_search", _entity_sql(["blue", "brass"], 60))
def _(t):
    """Six weighted fields, three tiers, one reading of the written index: both words in title or
    alternates, then one of them there, then one in any field."""
    index = fulltext.index_of(_six(t), "p_partkey", SIX, f"{t.sf_dir}#six")
    return fulltext.field_tiers(index, ["blue", "brass"], ["title", "alternates"], _WEIGHTS, 60)


@query("entity_search_any_field", _entity_sql(["zebra", "supplier"], 30))
def _(t):
    """No part has the words in title or alternates: the last tier reads the other fields."""
    index = fulltext.index_of(_six(t), "p_partkey", SIX, f"{t.sf_dir}#six")
    return fulltext.field_tiers(index, ["zebra", "supplier"], ["title", "alternates"], _WEIGHTS, 30)


@query("fts_prefix", f"with {POST} select distinct doc_id from posts where starts_with(token, 'inin')")
def _(t):
    return _texts(t).matches([["inin"]])


@query("fts_and", f"with {POST} select doc_id from posts group by doc_id having bool_or(starts_with(token, 'inin') or starts_with(token, 'stea')) and bool_or(starts_with(token, 'whst'))")
def _(t):
    return _texts(t).matches([["inin", "stea"], ["whst"]])


@query("fts_or", f"with {POST} select doc_id from posts group by doc_id having bool_or(starts_with(token, 'inin') or starts_with(token, 'uber'))")
def _(t):
    return _texts(t).matches([["inin"], ["uber"]], every=False)


@query("fts_field_filter", "select p_partkey from part where regexp_matches(lower(p_name), '\\bbl')")
def _(t):
    return fulltext.matches(_parts(t).postings.where("field = 'p_name'"), "p_partkey", [["bl"]])


def _bm25_sql(source: str, key: str, terms: list[str], score: str, where: str, weight: str = "tf", fields: str = "true") -> str:
    sums = ", ".join(f"sum(case when starts_with(token, '{x}') and {fields} then {weight} else 0 end) as f{i}" for i, x in enumerate(terms))
    seen = ", ".join(f"cast(sum(case when f{i} > 0 then 1 else 0 end) as double) as d{i}" for i in range(len(terms)))
    return f"with {source}, h as (select {key}, {sums} from posts group by {key}), tot as (select count(*) as n, avg(len) as avgdl from lens), seen as (select {seen} from h) select {key}, round({score}, 6) as score from h join lens using ({key}), tot, seen where {where}"


@query("fts_stemmed", _bm25_sql(POST, "doc_id", ["end", "shed"], f"{_leaf(0)} + {_leaf(1)}", "f0 > 0 or f1 > 0"))
def _(t):
    """Documents by a word's stem, from the stemmed index."""
    return _texts(t, True).bm25([["ending"], ["shed"]]).withColumn("score", F.round("score", 6))


@query("bm25", _bm25_sql(POST, "doc_id", ["inin", "whst"], f"{_leaf(0)} + {_leaf(1)}", "f0 > 0 or f1 > 0"))
def _(t):
    return _texts(t).bm25([["inin"], ["whst"]]).withColumn("score", F.round("score", 6))


@query("fts_compound", _bm25_sql(POST, "doc_id", ["inin", "whst", "thwh"], f"case when f0 > 0 and f1 > 0 then {_leaf(0)} + {_leaf(1)} else 0 end + {_leaf(2)}", "(f0 > 0 and f1 > 0) or f2 > 0"))
def _(t):
    return _texts(t).bm25([["inin"], ["whst"]], every=True, compound=["thwh"]).withColumn("score", F.round("score", 6))


@query("fts_topk", _bm25_sql(POST, "doc_id", ["inin", "stea"], f"{_leaf(0)} + {_leaf(1)}", "f0 > 0 or f1 > 0") + " order by score, doc_id limit 20")
def _(t):
    return ranking.top(_texts(t).bm25([["inin"], ["stea"]]).withColumn("score", F.round("score", 6)), ["score", "doc_id"], 20)


PARTS = f"posts as (select p_partkey, field, token, count(*) as tf from (select p_partkey, 'p_name' as field, unnest({T1.format('p_name')}) as token from part union all select p_partkey, 'p_type', unnest({T1.format('p_type')}) from part) group by all), lens as (select p_partkey, sum(tf) as len from posts group by p_partkey)"


@query("bm25_weighted", _bm25_sql(PARTS, "p_partkey", ["bl", "brass"], f"{_leaf(0)} + {_leaf(1)}", "f0 > 0 or f1 > 0", "tf * case when field = 'p_name' then 12e0 else 2e0 end"))
def _(t):
    return _parts(t).bm25([["bl"], ["brass"]], weights={"p_name": 12, "p_type": 2}).withColumn("score", F.round("score", 6))


STOP = ["the", "and", "this"]


@query("query_terms", f"select conv_id, turn, list_filter(list_distinct_ordered, lambda w: length(w) > 2 and w not in ('the', 'and', 'this') and not regexp_matches(w, '^[0-9]+$')) as terms from (select conv_id, turn, list_filter(ts, lambda w, i: list_position(ts, w) = i) as list_distinct_ordered from (select conv_id, turn, {T1.format('text')} as ts from conversations))")
def _(t):
    return t.conversations.select("conv_id", "turn", text.query_terms_col(C("text"), STOP, 3, digits=False).alias("terms"))


@query("query_terms_allow", f"select conv_id, turn, list_filter(u, lambda w: (length(w) >= 3 or w in ('be', 'it')) and w not in ('the', 'and', 'this')) as terms from (select conv_id, turn, list_filter(ts, lambda w, i: list_position(ts, w) = i) as u from (select conv_id, turn, {T1.format('text')} as ts from conversations))")
def _(t):
    return t.conversations.select("conv_id", "turn", text.query_terms_col(C("text"), STOP, 3, ["be", "it"]).alias("terms"))


@query("synonym_expand", "select p_partkey, lower(t) as term, coalesce(s, lower(t)) as alias from (select p_partkey, unnest(string_split(p_type, ' ')) as t from part) left join (values ('brass', 'metal'), ('steel', 'metal')) v(k, s) on lower(t) = k")
def _(t):
    lexicon = t.spark.createDataFrame([("brass", "metal"), ("steel", "metal")], "term string, alias string")
    rows = t.part.select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    return rows.join(F.broadcast(lexicon), "term", "left").select("p_partkey", "term", F.coalesce("alias", "term").alias("alias"))


@query("verify_whole_word", "select code, description from program where regexp_matches(lower(description), '\\bblue\\w?\\b')", "program")
def _(t):
    return t.program.where(C("description").rlike(text.whole_word("blue"))).select("code", "description")


@query("match_count", "select code, max(cast(contains(description, 'blue') as int) + cast(contains(description, 'widget') as int)) as hits from program group by code", "program")
def _(t):
    hits = C("description").contains("blue").cast("int") + C("description").contains("widget").cast("int")
    return t.program.groupBy("code").agg(F.max(hits).alias("hits"))


@query("cascade", "select code, tier from (select code, tier, min(tier) over () as least from (select code, case when contains(description, 'blue') and contains(description, 'zebra') then 0 when contains(description, 'blue') or contains(description, 'zebra') then 1 else 2 end as tier from program)) where tier = least group by all", "program")
def _(t):
    b, z = C("description").contains("blue"), C("description").contains("zebra")
    tiers = t.program.select("code", F.when(b & z, 0).when(b | z, 1).otherwise(2).alias("tier")).distinct()
    return ranking.cascade(tiers)


# Geography

MILES = "(case when lat is not null and lon is not null then 2 * 3958.8e0 * asin(sqrt(least(1.0e0, pow(sin(radians({0} - 37.0e0) / 2), 2) + cos(radians(37.0e0)) * cos(radians({0})) * pow(sin(radians({1} - -95.0e0) / 2), 2)))) end)".format("lat", "lon")
AT = (37.0, -95.0)


def _miles(t):
    return geo.haversine(F.lit(AT[0]), F.lit(AT[1]), C("lat"), C("lon"))


@query("haversine", f"select code, round({MILES}, 6) as miles from facility", "facility")
def _(t):
    return t.facility.select("code", F.round(_miles(t), 6).alias("miles"))


def within(rows, at, miles):
    """Rows within the radius: the box first, on plain columns, then the distance."""
    d = geo.haversine(F.lit(at[0]), F.lit(at[1]), C("lat"), C("lon"))
    return rows.where(geo.in_box(C("lat"), C("lon"), at, miles)).withColumn("miles", d).where(C("miles") <= miles)


@query("geo_radius", f"select code, round({MILES}, 4) as miles from facility where approved and {MILES} <= 600", "facility")
def _(t):
    return within(t.facility.where("approved"), AT, 600.0).select("code", F.round("miles", 4).alias("miles"))


@query("geo_topk", f"select code, round({MILES}, 4) as miles from facility where approved and lat is not null order by {MILES}, code limit 12", "facility")
def _(t):
    rows = t.facility.where(C("approved") & C("lat").isNotNull()).withColumn("miles", _miles(t))
    return ranking.top(rows, ["miles", "code"], 12).select("code", F.round("miles", 4).alias("miles"))


@query("geo_nearest_any", f"select code, round({MILES}, 4) as miles from facility where approved and (is_employer or is_school) and {MILES} <= 500 order by {MILES}, code limit 4", "facility")
def _(t):
    return ranking.top(within(t.facility.where(C("approved") & (C("is_employer") | C("is_school"))), AT, 500.0), ["miles", "code"], 4).select("code", F.round("miles", 4).alias("miles"))


@query("geo_by_zip", """with spot as (select lat as y, lon as x from zcta where zip = (select min(zip) from zcta))
select code, round(2 * 3958.8e0 * asin(sqrt(least(1.0e0, pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))), 4) as miles from facility, spot
where 2 * 3958.8e0 * asin(sqrt(least(1.0e0, pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) <= 900""", "facility zcta")
def _(t):
    """The point comes from a one-row lookup; an unknown ZIP gives no rows."""
    at = t.zcta.agg(F.min_by(F.struct("lat", "lon"), "zip").alias("at")).select("at.*")
    rows = t.facility.select("code", C("lat").alias("y"), C("lon").alias("x"))
    return located.geo_join(at, rows, 900.0, right_lat="y", right_lon="x").select("code", F.round("miles", 4).alias("miles"))


@query("zip_fallback", """with m as (select f.code, f.zip, z.lat, row_number() over (partition by f.code order by abs(cast(f.zip as int) - cast(z.zip as int)), z.zip) as k from facility f join zcta z on substr(f.zip, 1, 3) = substr(z.zip, 1, 3))
select code, lat from m where k = 1""", "facility zcta")
def _(t):
    """Each facility's ZIP, or else the nearest number with the same three first digits."""
    return _zip_fallback(t.facility, t.zcta)


def _zip_fallback(facility: DataFrame, zcta: DataFrame) -> DataFrame:
    """Of each number asked only the next one below and above are looked at, in the order of numbers."""
    first, number = F.substring("zip", 1, 3).alias("p"), C("zip").cast("int").alias("n")
    held = zcta.select(first, number, F.lit(0).alias("asks"), C("zip").alias("z"), F.struct("zip", "lat").alias("at"))
    asked = facility.select("zip").distinct().select(first, number, F.lit(1).alias("asks"), "zip", F.lit(None).cast(held.schema["at"].dataType).alias("at"))
    own = Window.partitionBy("p")
    up, down = (own.orderBy(n, "asks", C("z").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow) for n in (C("n"), C("n").desc()))
    both = held.unionByName(asked.withColumnRenamed("zip", "z")).withColumns({"below": F.last("at", True).over(up), "above": F.last("at", True).over(down)}).where("asks = 1")
    near = both.select(C("z").alias("zip"), "n", F.explode(F.array("below", "above")).alias("at")).where("at IS NOT NULL")
    gap = F.abs(C("n") - C("at.zip").cast("int"))
    return facility.select("code", "zip").join(near, "zip").groupBy("code").agg(F.min_by("at.lat", F.struct(gap, "at.zip")).alias("lat"))


_CITY = "select code, state as city, country as state, zip, lat, lon from facility"


def _cities(t):
    return t.facility.select("code", C("state").alias("city"), C("country").alias("state"), "zip", "lat", "lon")


@query("resolve_area", f"""with c as ({_CITY}), hit as (select * from c where city = 'NATION_20' and state = 'AFRICA'),
z as (select zip, count(*) as n from hit group by zip order by n desc, zip limit 1)
select 'Nation_20, AFRICA' as label, 'NATION_20' as city, 'AFRICA' as state, coalesce(any_value(q.lat), avg(hit.lat)) as lat, coalesce(any_value(q.lon), avg(hit.lon)) as lon, any_value(z.zip) as zip from hit, z left join zcta q on z.zip = q.zip""", "facility zcta")
def _(t):
    """A city whose state is named too; nation_1 is in the text as well, but is no word of it."""
    return places.resolve_area("schools near Nation 20 in Africa", _cities(t), t.zcta, {"africa": "AFRICA", "asia": "ASIA"})


@query("resolve_state", f"with c as ({_CITY}) select 'AFRICA' as label, cast(null as varchar) as city, 'AFRICA' as state, avg(lat) as lat, avg(lon) as lon, (select zip from c where state = 'AFRICA' group by zip order by count(*) desc, zip limit 1) as zip from c where state = 'AFRICA'", "facility")
def _(t):
    return places.resolve_area("anywhere in Africa", _cities(t), t.zcta, {"africa": "AFRICA", "asia": "ASIA"})


@query("area_candidates", f"with c as (select code, 'NATION_' || (code % 2) as city, state from ({_CITY})) select city, state, count(*) as n, upper(city[1:1]) || lower(city[2:]) || ', ' || state as label from c where city = 'NATION_1' group by all order by n desc, city, state limit 6", "facility")
def _(t):
    """Places of one name in several states."""
    rows = _cities(t).withColumn("city", F.concat(F.lit("NATION_"), (C("code") % 2).cast("string")))
    return places.candidates("near nation 1", rows)


# Vectors

COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


def _pair(t):
    q = t.embeddings.where("vec_id = 0").select(C("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q))


@query("cosine", f"select e.vec_id, round({COS}, 6) as score from embeddings e, embeddings q where q.vec_id = 0")
def _(t):
    return _pair(t).select("vec_id", F.round(vector.cosine(C("embedding"), C("q")), 6).alias("score"))


@query("hybrid_score", f"""with v as (select vec_id, embedding, list_distinct({T1.format("name")}) as ts from embeddings join (select cast(p_partkey as bigint) as k, p_name || ' ' || p_type as name from part) on vec_id = k),
s as (select v.vec_id, {COS.replace('e.embedding', 'v.embedding')} + 0.05e0 * cast(len(list_intersect(v.ts, ['small', 'ring', 'steel'])) as double) / 3 as score from v, embeddings q where q.vec_id = 1)
select vec_id, round(score, 6) as score from s where score >= 0.05""")
def _(t):
    """Likeness and a share of the query's words in the name."""
    q = t.embeddings.where("vec_id = 1").select(C("embedding").alias("q"))
    names = t.part.select(C("p_partkey").cast("bigint").alias("vec_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    rows = t.embeddings.join(names, "vec_id").join(F.broadcast(q))
    score = vector.hybrid(C("embedding"), C("q"), F.array(*map(F.lit, ("small", "ring", "steel"))), text.tokens(C("name")))
    return rows.withColumn("score", score).where("score >= 0.05").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk", f"select e.vec_id, round({COS}, 6) as score from embeddings e, embeddings q where q.vec_id = 0 and {COS} >= 0.05 order by round({COS}, 6) desc, e.vec_id limit 200")
def _(t):
    rows = _pair(t).withColumn("score", F.round(vector.dot(vector.unit(C("embedding")), vector.unit(C("q"))), 6)).where("score >= 0.05")
    return ranking.top(rows, [C("score").desc(), "vec_id"], 200).select("vec_id", "score")


@query("embed_encode")
def _(t):
    return t.part.select("p_name").distinct().withColumn("embedding", vector.hashing_encoder()(C("p_name")))


@query("semantic_geo_topk", f"""with q as (select embedding from embeddings where vec_id = 0), s as (select code, {MILES} as miles, round({COS.replace('q.embedding', '(select embedding from q)')}, 6) as score from facility f join embeddings e on f.code = e.vec_id where approved)
select code, score, round(miles, 4) as miles from s where miles <= 1500 order by score desc, miles, code limit 10""", "facility")
def _(t):
    """Distance first: similarity is worked out for what is near only."""
    q = t.embeddings.where("vec_id = 0").select(C("embedding").alias("q"))
    near = within(t.facility.where("approved"), AT, 1500.0).select("code", "miles")
    rows = near.join(t.embeddings, C("code") == C("vec_id")).join(F.broadcast(q)).withColumn("score", F.round(vector.cosine(C("embedding"), C("q")), 6))
    return ranking.top(rows, [C("score").desc(), "miles", "code"], 10).select("code", "score", F.round("miles", 4).alias("miles"))


@query("semantic_group", f"""with q as (select embedding from embeddings where vec_id = 0), s as (select e.label, e.vec_id, round({COS.replace('q.embedding', '(select embedding from q)')}, 6) as score from embeddings e),
top as (select * from s where score >= 0.05 order by score desc, vec_id limit 200) select label, max(score) as score, count(*) as n from top group by label""")
def _(t):
    return semantic_programs(t.embeddings, t.embeddings.where("vec_id = 0"), "label", 0.05, 200)


# Graph


@query("src_ntriples", "select s, p, o from triples", "triples")
def _(t):
    return t.triples


def _graph(t):
    """The stored triples, by predicate."""
    return graph.store_of(t.triples, t.sf_dir)


@query("graph_bgp", "select a.s as supplier, b.o as region from triples a join triples b on a.o = b.s where a.p = 'inNation' and b.p = 'inRegion'", "triples")
def _(t):
    return graph.match(_graph(t), [("?supplier", "inNation", "?n"), ("?n", "inRegion", "?region")]).select("supplier", "region")


@query("graph_alt_path", "select s, o from triples where p in ('title', 'name')", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", ["title", "name"], "?o")


@query("graph_filter_in", "select s from triples where p = 'inRegion' and o in ('r/1', 'r/2')", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", "inRegion", "?o").where(C("o").isin("r/1", "r/2")).select("s")


@query("graph_count", "select count(*) as n from triples where p = 'inNation'", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", "inNation", "?o").agg(F.count("*").alias("n"))


@query("graph_distinct", "select distinct o from triples where p = 'inNation' order by o limit 10", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", "inNation", "?o").select("o").distinct().orderBy("o").limit(10)


@query("graph_group_max", "select b.o as region, max(t.o) as name from triples a join triples b on a.o = b.s and b.p = 'inRegion' join triples t on t.s = a.s and t.p = 'name' where a.p = 'inNation' group by b.o order by region limit 12", "triples")
def _(t):
    rows = graph.match(_graph(t), [("?s", "inNation", "?n"), ("?n", "inRegion", "?region"), ("?s", "name", "?name")])
    return rows.groupBy("region").agg(F.max("name").alias("name")).orderBy("region").limit(12)


@query("graph_related", "select b.s as other, t.o as title from triples a join triples b on a.o = b.o and a.s <> b.s and b.p = 'inRegion' join triples t on t.s = b.s and t.p = 'title' where a.p = 'inRegion' and a.s = 'n/3' order by title limit 8", "triples")
def _(t):
    rows = graph.match(_graph(t), [("n/3", "inRegion", "?r"), ("?other", "inRegion", "?r"), ("?other", "title", "?title")]).where("other <> 'n/3'")
    return rows.select("other", "title").orderBy("title").limit(8)


@query("graph_union", "select s, o from triples where p = 'title' union all select s, o from triples where p = 'name'", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", "title", "?o").unionByName(graph.pattern(_graph(t), "?s", "name", "?o"))


@query("iri_tail", "select s, regexp_extract(s, '[^/#]+$', 0) as tail from triples where p = 'title'", "triples")
def _(t):
    return graph.pattern(_graph(t), "?s", "title", "?o").select("s", graph.tail(C("s")).alias("tail"))


@query("entity_facts", """with x as (select a.o as s, t.o as name from triples a join triples t on t.s = a.s and t.p = 'name' where a.p = 'inNation'),
r as (select a.s, b.o as region from triples a join triples b on a.o = b.s and b.p = 'title' where a.p = 'inRegion')
select n.s, n.o as title, (select list(name order by name) from x where x.s = n.s) as suppliers, (select count(*) from x where x.s = n.s) as n_suppliers, (select list(name order by name)[1:3] from x where x.s = n.s) as first_suppliers, r.region, (select count(*) from triples m where m.s = n.s) as n_facts
from triples n join r on r.s = n.s where n.p = 'title'""", "triples")
def _(t):
    """All entities' facts in one plan: each facet is a pattern, gathered by entity."""
    own = graph.match(_graph(t), [("?s", "title", "?title"), ("?s", "inRegion", "?r"), ("?r", "title", "?region")]).select("s", "title", "region")
    sold = graph.match(_graph(t), [("?x", "inNation", "?s"), ("?x", "name", "?name")]).groupBy("s").agg(F.sort_array(F.collect_list("name")).alias("suppliers"), F.count("*").alias("n_suppliers"))
    facts = _graph(t).groupBy("s").agg(F.count("*").alias("n_facts"))
    rows = own.join(sold, "s", "left").join(facts, "s", "left")
    return rows.select("s", "title", "suppliers", F.coalesce("n_suppliers", F.lit(0).cast("bigint")).alias("n_suppliers"), F.slice("suppliers", 1, 3).alias("first_suppliers"), "region", "n_facts")


@query("entity_by_code", "select s, o as title, regexp_extract(o, '^([^_]*)_', 1) as category, regexp_extract(o, '_(.*)$', 1) as part from triples where p = 'title' and s = (select max(s) from triples where p = 'inRegion')", "triples")
def _(t):
    """An entity by its code, with the two sides of its category."""
    code = graph.pattern(_graph(t), "?s", "inRegion", "?r").agg(F.max("s").alias("s"))
    halves = F.split("title", "_", 2)
    return graph.pattern(_graph(t), "?s", "title", "?title").join(F.broadcast(code), "s").withColumns({"category": F.get(halves, F.lit(0)), "part": F.get(halves, F.lit(1))})


@query("point_lookup_norm", "select code from facility where regexp_replace(trim(lower(name)), '[ ]+', ' ', 'g') = 'supplier#000000005'", "facility")
def _(t):
    return t.facility.where(text.squeeze(C("name")) == "supplier#000000005").select("code")


@query("crosswalk_topk", f"""with c as (select unitid, cip, sum(awards) as awards from completions group by all)
select unitid, cip, awards, round({MILES}, 4) as miles, total from (select c.*, lat, lon, count(*) over () as total from c join facility f on unitid = code where cip in (select cip from crosswalk where soc = (select min(soc) from crosswalk)))
order by {MILES} nulls last, awards desc, unitid, cip limit 20""", "completions crosswalk facility")
def _(t):
    return crosswalk_programs(t).withColumn("miles", F.round("miles", 4))


def crosswalk_programs(t, soc=None, at=AT, k=20):
    """Programs that lead to an occupation, nearest first, more awards first, with the total before
    the cut. Institutions without coordinates come last."""
    want = t.crosswalk.agg(F.min("soc").alias("soc")) if soc is None else t.spark.createDataFrame([(soc,)], "soc string")
    cips = t.crosswalk.join(F.broadcast(want), "soc").select("cip").distinct()
    rows = t.completions.join(cips, "cip").groupBy("unitid", "cip").agg(F.sum("awards").alias("awards"))
    rows = rows.join(t.facility.select(C("code").alias("unitid"), "lat", "lon"), "unitid")
    rows = rows.withColumn("miles", geo.haversine(F.lit(at[0]), F.lit(at[1]), C("lat"), C("lon"))).drop("lat", "lon")
    total = rows.agg(F.count("*").alias("total"))
    return ranking.top(rows, [C("miles").asc_nulls_last(), C("awards").desc(), "unitid", "cip"], k).crossJoin(F.broadcast(total))


# The whole search

def _search_sql(first: str, second: str, miles: float, order: str) -> str:
    """The search of two terms, as SQL: BM25 of descriptions by prefix, whole words, place, then tier."""
    return f"""with prog as materialized (select *, code || '|' || ptype || '|' || description as pid from program), d as (select pid, unnest({T1.format("description")}) as token from prog),
posts as materialized (select pid, token, count(*) as tf from d group by all), lens as (select pid, sum(tf) as len from posts group by pid),
h as materialized (select pid, sum(case when starts_with(token, '{first}') then tf else 0 end) as f0, sum(case when starts_with(token, '{second}') then tf else 0 end) as f1 from posts group by pid),
tot as (select count(*) as n, avg(len) as avgdl from lens), seen as (select cast(count(*) filter (where f0 > 0) as double) as d0, cast(count(*) filter (where f1 > 0) as double) as d1 from h),
ranked as (select pid, round({_leaf(0)} + {_leaf(1)}, 6) as rank from h join lens using (pid), tot, seen where f0 > 0 or f1 > 0),
near as materialized (select code, name, {MILES} as miles from facility where approved and lat is not null and {MILES} <= {miles}),
hit as materialized (select code, ptype, description, name, miles, rank, cast(regexp_matches(description, '(?i)\\b{first}\\w?\\b') as int) + cast(regexp_matches(description, '(?i)\\b{second}\\w?\\b') as int) as hits from prog join ranked using (pid) join near using (code)),
pick as (select *, row_number() over (partition by code order by rank, description, ptype) as k from (select *, max(hits) over () as most from hit where hits > 0) where hits = 2 or most < 2),
g as (select code, name, miles, count(*) as n_programs, min(rank) as best_rank, max(hits) as hits, string_agg(description, '|' order by rank, description, ptype) filter (where k <= 6) as programs from pick group by all)
select code, name, programs, n_programs, best_rank, hits, round(miles, 4) as miles, count(*) over () as total_facilities, cast(sum(n_programs) over () as bigint) as total_programs, greatest(0, count(*) over () - 100) as remaining from g order by {order} limit 100"""


def _found(t, terms, miles):
    rows = program_search(t.program, t.facility, Spec(terms, at=AT, miles=miles), index=program_index(t.program, t.sf_dir))
    return rows.select("code", "name", F.array_join(C("programs.description"), "|").alias("programs"), "n_programs", "best_rank", "hits", F.round("miles", 4).alias("miles"), "total_facilities", "total_programs", "remaining")


@query("program_search", _search_sql("blue", "widget", 2000.0, "g.miles, best_rank, code"), "program facility")
def _(t):
    return _found(t, ["blue", "widget"], 2000.0)


@query("program_search_relaxed_near", _search_sql("blue", "zebra", 900.0, "g.miles, hits desc, best_rank, code"), "program facility")
def _(t):
    """No program has both terms near: those with one of them are taken."""
    return _found(t, ["blue", "zebra"], 900.0)


def _described(t):
    """Vectors of program descriptions: those of the parts that they name."""
    part = t.part.select(C("p_partkey").cast("bigint").alias("vec_id"), F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("description"))
    return part.join(t.embeddings, "vec_id").select("description", "embedding")


@query("program_search_semantic", f"""with q as (select embedding from embeddings where vec_id = 0), v as (select p_name || ' ' || lower(p_brand) as description, max(round({COS.replace('q.embedding', '(select embedding from q)')}, 6)) as score from part join embeddings e on cast(p_partkey as bigint) = e.vec_id group by 1),
alike as (select description, score from v where score >= 0.05 order by score desc, description limit 200),
near as (select code, name, {MILES} as miles from facility where approved and lat is not null and upper(country) = 'ASIA' and {MILES} <= 1500),
hit as (select code, name, miles, ptype, description, -score as rank from program join alike using (description) join near using (code)),
pick as (select *, row_number() over (partition by code order by rank, description, ptype) as k from hit),
g as (select code, name, miles, count(*) as n_programs, min(rank) as best_rank, string_agg(description, '|' order by rank, description, ptype) filter (where k <= 6) as programs from pick group by all)
select code, name, programs, n_programs, best_rank, round(miles, 4) as miles, count(*) over () as total_facilities, cast(sum(n_programs) over () as bigint) as total_programs from g order by g.miles, best_rank, code limit 100""", "program facility")
def _(t):
    """No program has a word of the request: those of like meaning are taken, by facility, within a
    state and a radius."""
    query = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    spec = Spec(["quokka", "zebra"], at=AT, miles=1500.0, state="asia")
    places_of = t.facility.withColumn("state", C("country"))
    rows = program_search(t.program, places_of, spec, similar.most_alike(_described(t), query, 200, 0.05), program_index(t.program, t.sf_dir))
    return rows.select("code", "name", F.array_join(C("programs.description"), "|").alias("programs"), "n_programs", "best_rank", F.round("miles", 4).alias("miles"), "total_facilities", "total_programs")


def _orders_sql() -> str:
    inner = _search_sql("blue", "zebra", 900.0, "g.miles, hits desc, best_rank, code").replace(" limit 100", "")
    pick = {"distance": "miles, -hits, best_rank, code", "matches": "hits desc, miles, best_rank, code", "rank": "best_rank, miles, -hits, code", "name": "lower(name), name, code"}
    ranked = ", ".join(f"row_number() over (order by {o}) as r_{m}" for m, o in pick.items())
    head, _, tail = inner.rpartition("\nselect ")
    body = tail.replace("round(miles, 4) as miles", "miles")
    return f"{head},\na as (select *, {ranked} from (select {body}))\n" + " union all ".join(f"select '{m}' as mode, code, best_rank, hits from a where r_{m} <= 7" for m in pick)


@query("program_search_orders", _orders_sql(), "program facility")
def _(t):
    """The first seven facilities of one request in each order that can be asked for."""
    specs = [Spec(["blue", "zebra"], at=AT, miles=900.0, size=7, order=mode) for mode in ORDERS]
    pages = program_pages(t.program, t.facility, specs, program_index(t.program, t.sf_dir))
    return reduce(DataFrame.unionByName, [p.select(F.lit(s.order).alias("mode"), "code", "best_rank", "hits") for p, s in zip(pages, specs, strict=True)])


@query("search_rank_distance", f"select code, round({MILES}, 4) as miles from facility where lat is not null order by {MILES}, code limit 100", "facility")
def _(t):
    return ranking.top(t.facility.where("lat is not null").withColumn("miles", _miles(t)), ["miles", "code"], 100).select("code", F.round("miles", 4).alias("miles"))


@query("search_rank_matches", "select code, count(*) as n from program where contains(description, 'blue') group by code order by n desc, code limit 100", "program")
def _(t):
    rows = t.program.where(C("description").contains("blue")).groupBy("code").agg(F.count("*").alias("n"))
    return ranking.top(rows, [C("n").desc(), "code"], 100)


@query("search_within", f"with r as (select code from facility where approved and lat is not null order by {MILES}, code limit 40) select p.code, count(*) as n from program p join r on p.code = r.code where contains(p.description, 'blue') group by p.code", "program facility")
def _(t):
    """A search within an earlier result."""
    from ..search import within_results

    near = ranking.top(t.facility.where(C("approved") & C("lat").isNotNull()).withColumn("miles", _miles(t)), ["miles", "code"], 40)
    return within_results(t.program.where(C("description").contains("blue")), near).groupBy("code").agg(F.count("*").alias("n"))


@query("search_chain", "select code, 'school' as stage, exists (select 1 from program p where p.code = f.code and contains(p.description, 'hot')) as verified from facility f where approved and is_school", "facility program")
def _(t):
    """A chain of fallbacks: nothing is rated as high as is asked, so schools are taken."""
    from ..search import first_that_answers

    f = t.facility.where("approved").select("code", "rate", "is_school")
    stages = [("employer", f.where("rate > 1e9")), ("school", f.where("is_school")), ("nearest", f)]
    return first_that_answers(stages, t.program.where(C("description").contains("hot"))).select("code", "stage", "verified")


@query("first_of_names", "select code, coalesce(case when code % 3 = 0 then null when code % 3 = 1 then '' else name end, state) as name from facility", "facility")
def _(t):
    """Present but empty wins."""
    first = F.when(C("code") % 3 == 0, None).when(C("code") % 3 == 1, "").otherwise(C("name"))
    return t.facility.select("code", text.first_present(first, C("state")).alias("name"))


@query("search_rank_best", _bm25_sql(POST, "doc_id", ["inin", "stea"], f"{_leaf(0)} + {_leaf(1)}", "f0 > 0 and f1 > 0") + " order by score, doc_id limit 100")
def _(t):
    """Best rank first: the order of a search without a place."""
    return ranking.top(_texts(t).bm25([["inin"], ["stea"]], every=True).withColumn("score", F.round("score", 6)), ["score", "doc_id"], 100)
