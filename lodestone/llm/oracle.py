"""DuckDB SQL for the queries of this package that SQL can express."""

from .licenses import TEMPLATES, THRESHOLD
from .quality import BOILERPLATE, CLOSERS, CRUMB, MARKS, MENU, NO_LETTER

W = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{W}'), lambda w: w <> '')"


def _q(text: str) -> str:
    return text.replace("'", "''")


URLS = """
with rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (select page_id, url, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
part as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fit as (select part.*, h || p as rule, v, row_number() over (partition by page_id order by len(string_split(h, '.')) desc nulls last, length(p) desc) as k
  from part left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fit where k = 1
"""

_BOIL = " or ".join(f"contains(lower(l), '{_q(p)}')" for p in BOILERPLATE)
_MENU = ", ".join(f"'{w}'" for w in MENU)
_MARKS = ", ".join(f"'{m}'" for m in MARKS)

QUALITY = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, {_words("text")} as ws, string_split(text, chr(10)) as ls from t),
win as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) >= 5),
grams as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from win),
twice as (select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct i + j) as n from twice, range(0, 5) as r(j) group by doc_id),
line as (select doc_id, unnest(ls) as l from w),
words as (select doc_id, l, {_words("l")} as lw, len(regexp_split_to_array(l, '{CRUMB}')) as items, list_filter(regexp_split_to_array(lower(l), '{NO_LETTER}'), lambda w: w <> '') as lets from line),
failing as (select doc_id, sum(length(array_to_string(lw, ''))) as lost from words where len(lw) > 0 and (
  100 * length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) > 30 * len(lw)
  or (length(l) - length(replace(l, '!!', ''))) >= 6
  or (len(lw) >= 5 and upper(l) = l and lower(l) <> l)
  or (len(lw) >= 4 and right(rtrim(l, '{_q(CLOSERS)}'), 1) not in ({_MARKS}))
  or (items >= 3 and len(lw) <= 4 * items and not starts_with(l, '|'))
  or (len(lw) between 2 and 12 and 100 * len(list_filter(lets, lambda x: x in ({_MENU}))) >= 60 * len(lets))
  or {_BOIL}) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) as n from words where len(lw) > 0 group by doc_id),
base as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
  cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost, 0) as bigint) as lost_chars
  from w left join dup using (doc_id) left join covered using (doc_id) left join failing using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not 100 * lost_chars > 40 * word_chars as kept, lost_chars from base
"""

DECONTAMINATION = f"""
with masks(m, o) as (values (0, [0, 1, 2, 4, 5, 6]), (1, [0, 1, 3, 4, 6, 7]), (2, [0, 1, 4, 6, 8, 9])),
plain as (select 'd' as t, doc_id as id, regexp_replace(lower(coalesce(text, '')), '[[:punct:]]+', '', 'g') as x from documents
  union all select 'b', item_id, regexp_replace(lower(coalesce(text, '')), '[[:punct:]]+', '', 'g') from benchmark),
w as (select t, id, {_words("x")} as ws from plain),
d as (select id as doc_id, ws from w where t = 'd'),
b as (select min(id) as item_id, ws from w where t = 'b' group by ws),
dk as (select doc_id, m, p, array_to_string(list_transform(o, lambda x: ws[p + x + 1]), ' ') as k
  from (select doc_id, m, o, ws, unnest(range(0, len(ws) - o[-1])) as p from d, masks)),
bk as (select item_id, m, p, array_to_string(list_transform(o, lambda x: ws[p + x + 1]), ' ') as k
  from (select item_id, m, o, ws, unnest(range(0, len(ws) - o[-1])) as p from b, masks)),
diag as (select distinct doc_id, item_id, dk.p - bk.p as g from dk join bk using (m, k)),
side as (select doc_id, item_id, g, least(13, len(b.ws)) as win, d.ws as dw, b.ws as bw,
  unnest(range(greatest(g, 0), least(len(d.ws), len(b.ws) + g))) as p from diag join d using (doc_id) join b using (item_id)),
eq as (select doc_id, item_id, g, win, p, cast(dw[p + 1] = bw[p - g + 1] as int) as e from side),
sums as (select *, sum(e) over (partition by doc_id, item_id, g order by p rows between 12 preceding and current row) as s13,
  sum(e) over (partition by doc_id, item_id, g order by p) as run, row_number() over (partition by doc_id, item_id, g order by p) as k from eq),
best as (select doc_id, item_id, g, win, greatest(g, 0) as doc_at, count(*) as aligned, sum(e) as matched,
  max(case when k >= win then (case when win = 13 then s13 else run end) end) as best from sums group by all),
fine as (select * from best where 100 * best >= 80 * win)
select doc_id, item_id, cast(doc_at as int) as doc_at, cast(aligned as int) as aligned, cast(matched as int) as matched, cast(best as int) as best, n as diagonals
from (select *, count(*) over (partition by doc_id, item_id) as n,
  row_number() over (partition by doc_id, item_id order by best desc, matched desc, doc_at, aligned desc) as r from fine) where r = 1
"""

_TEMPLATES = ", ".join(f"('{k}', {i}, '{_q(v)}')" for k, vs in TEMPLATES.items() for i, v in enumerate(vs))
_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"

LICENSES = f"""
with tpl(license, k, body) as (values {_TEMPLATES}),
tt as (select license, k, term, cast(count(*) as double) as tf from (select license, k, unnest({_TERMS.format("body")}) as term from tpl) group by all),
docs as (select doc_id, lower(coalesce(text, '')) as text, concat_ws('/', source, lang, 'd' || (doc_id % 4), case when doc_id % 2 = 1 then 'e' || (doc_id % 63) end) as dir from documents),
n as (select count(*) as n from docs),
df as (select term, count(distinct doc_id) as df from (select doc_id, unnest({_TERMS.format("text")}) as term from docs) group by term),
tw as (select license, k, tt.term, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) as x from tt left join df using (term), n),
size as (select license, k, sqrt(sum(x * x)) as len from tw group by all),
part as (select doc_id, 0 as kind, string_split(text, chr(10)) as ps from docs
  union all select doc_id, 1, regexp_split_to_array(text, '\\n[^a-z0-9]*\\n') from docs union all select doc_id, 2, [text] from docs),
unit as (select doc_id, kind, unnest(range(0, len(ps))) as pos, unnest(ps) as u from part),
bag as (select doc_id, kind, pos, term, cast(count(*) as double) as tf from (select doc_id, kind, pos, unnest({_TERMS.format("u")}) as term from unit) group by all),
vec as (select doc_id, kind, pos, term, tf * (ln((1 + n) / (1 + df)) + 1) as x from bag join df using (term), n),
norm as (select doc_id, kind, pos, sqrt(sum(x * x)) as norm from vec group by all),
score as (select doc_id, kind, pos, license, k, round(sum(vec.x * tw.x) / any_value(len) / any_value(norm), 6) as score
  from vec join tw using (term) join norm using (doc_id, kind, pos) join size using (license, k) group by all),
own as (select doc_id, license, score, pos from score where score >= {THRESHOLD} qualify row_number() over (partition by doc_id order by score desc, kind, pos, license) = 1),
rows as (select docs.doc_id, dir, pos = 0 as gives, license, score from docs left join own using (doc_id)),
given as (select dir as from_dir, license as dir_license, score as dir_score from rows where gives and license is not null qualify row_number() over (partition by dir order by score desc, license) = 1),
near as (select d.dir, g.*, row_number() over (partition by d.dir order by length(g.from_dir) desc) as k from (select distinct dir from rows) d join given g on d.dir = g.from_dir or starts_with(d.dir, g.from_dir || '/'))
select doc_id, coalesce(license, dir_license) as license, coalesce(score, dir_score) as score,
  case when license is not null then 'own' when near.dir is not null then 'inherited' else 'none' end as origin,
  case when license is not null then rows.dir else from_dir end as from_dir
from rows left join near on rows.dir = near.dir and k = 1
"""

_SOUND = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _codebooks(rounds: int = 6) -> str:
    """Rounds of k-means written out: a part is long rows of components, a codebook likewise."""
    near = """select part, row, e as entry, d from (select part, row, e, sum((x - c) * (x - c)) as d from p join b{0} using (part, i) group by all)
  qualify row_number() over (partition by part, row order by d, e) = 1"""
    out = f"""
with v as materialized (select row_number() over (order by vec_id) as row, vec_id, label, embedding from embeddings where {_SOUND}),
p as materialized (select row, cast(i // w as int) as part, i % w as i, cast(floor(4096 * cast(embedding[i + 1] as double)) as bigint) as x
  from (select row, embedding, len(embedding) // 8 as w, unnest(range(len(embedding))) as i from v)),
b0 as materialized (select part, row - 1 as e, i, x as c from p where row <= 16)"""
    for r in range(rounds):
        out += f""",
n{r} as materialized ({near.format(r)}),
m{r} as (select part, entry as e, i, cast(sum(x) as hugeint) as s, cast(count(*) as hugeint) as n from p join n{r} using (part, row) group by all),
b{r + 1} as materialized (select part, e, i, coalesce(cast((s - ((s % n) + n) % n) / n as bigint), c) as c from b{r} left join m{r} using (part, e, i))"""
    return out + f""",
last as materialized ({near.format(rounds)}),
code as (select row, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from last group by row),
of_label as (select label, cast(sum(error) as bigint) as label_error from code join v using (row) group by label),
digest as (select sha256(string_agg(cast(c as varchar), ',' order by part, e, i)) as h from b{rounds})
select vec_id, code, error, label_error, h as codebooks_sha256 from code join v using (row) join of_label on v.label is not distinct from of_label.label, digest
"""


NEGATIVES = f"""
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings where label is not null and {_SOUND}),
s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank, id as negative_id, positive_score, score as negative_score
from pos join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
"""

SQL = {"op11_pq_trie": _codebooks(), "op13_hard_negatives": NEGATIVES, "op7_license_scan": LICENSES, "op6_decontamination": DECONTAMINATION, "op8_url_filter": URLS, "op10_quality_rules": QUALITY}
