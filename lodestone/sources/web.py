"""Pages: parse HTML, classify links, join addresses."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolved

PAGE = "title string, text array<string>, links array<struct<url:string,label:string>>"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.hidden, self.stack = "", [], [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag == "a":
            self.stack.append([dict(attrs).get("href") or "", []])
        elif tag == "title":
            self.stack.append(None)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.stack and self.stack[-1]:
            url, parts = self.stack.pop()
            if url:
                self.links.append({"url": url, "label": " ".join(" ".join(parts).split())})
        elif tag == "title" and self.stack and self.stack[-1] is None:
            self.stack.pop()

    def handle_data(self, data):
        run = " ".join(data.split())
        if not run or self.hidden:
            return
        if self.stack and self.stack[-1] is None:
            self.title = f"{self.title} {run}".strip()
            return
        self.text.append(run)
        if self.stack:
            self.stack[-1][1].append(run)


#: Pages that a task holds as Python's own strings at once; the rest of a batch is Arrow's.
AT_ONCE = 64
_KIND = pa.struct([("title", pa.string()), ("text", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("url", pa.string()), ("label", pa.string())])))])


def _structs(texts: list[str | None]) -> pa.Array:
    out = []
    for text in texts:
        p = _Page()
        p.feed(text or "")
        out.append({"title": p.title, "text": p.text, "links": p.links})
    return pa.array(out, _KIND)


def parse_batch(html: pa.Array) -> pa.Array:
    return pa.concat_arrays([_structs(html.slice(i, AT_ONCE).to_pylist()) for i in range(0, max(len(html), 1), AT_ONCE)])


def parsed(pages: DataFrame, html: str = "html", to: str = "page") -> DataFrame:
    """The pages with a struct of title, runs of visible text, and links with their labels."""

    @F.arrow_udf(PAGE)
    def parse(html: pa.Array) -> pa.Array:
        return parse_batch(html)

    return pages.withColumn(to, parse(html))


#: Whole words, of letters of any script.
_WORD = r"(?iu)(?<![\p{{L}}\p{{N}}_])({})(?![\p{{L}}\p{{N}}_])"


def classified(pages: DataFrame, key: str, wanted: list[str], unwanted: list[str], page: str = "page") -> DataFrame:
    """The best link of each page: labels with a wanted word come first, then addresses with one;
    those with an unwanted word are left out; ties go to the first on the page."""
    word = lambda ws: _WORD.format("|".join(ws))
    links = pages.select(key, F.posexplode(F.col(f"{page}.links")).alias("pos", "link")).select(key, "pos", "link.*")
    p = F.when(F.col("label").rlike(word(wanted)), 2).when(F.col("url").rlike(word(wanted)), 1).otherwise(0)
    links = links.where(~F.concat_ws(" ", "url", "label").rlike(word(unwanted))).withColumn("priority", p).where("priority > 0")
    best = links.groupBy(key).agg(F.min_by(F.struct("url", "label", "priority"), F.struct((-F.col("priority")).alias("p"), "pos")).alias("b"))
    return best.select(key, "b.*")


#: Words of admission pages, and marks of pages that offer employment instead.
ADMISSION = r"(?i)\bapply\b|\bapplication\b|\badmission|\benroll|\brequest\s+info|\bget\s+started\b|\bhow\s+to\s+apply\b"
EMPLOYMENT = r"(?i)careers?\.\w|jobs?\.\w|/careers?/|/jobs?/|/employment|human[\s-]?resources|\bhiring\b|\bjob\s+opening|\bwork(?:ing)?\s+at\b|\bstaff\s+position|\bfaculty\s+position"
#: Words of names that tell no institution from another.
NAME_STOP = ("academy", "and", "at", "campus", "center", "college", "communications", "community", "for", "in", "inc", "institute", "international", "llc", "main", "of", "school", "technical", "technology", "the", "training", "university")


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")


def apply_page(status: Column, final_url: Column, asked_url: Column, title: Column, runs: Column, body: Column, probe_status: Column, probe_body: Column) -> Column:
    """Whether a page asked for by a guessed path is one of its own about applying: it was found, is not
    the root, is of the same site, speaks of admission and not of employment, and does not begin as
    the answer to a path that cannot exist does."""
    from ..functions.text import host, same_site

    words = F.concat_ws(" ", title, F.array_join(F.slice(runs, 1, 20), " "), final_url)
    own = (status < 400) & (path_of(final_url) != "") & F.coalesce(same_site(host(final_url), host(asked_url)), F.lit(False))
    template = F.coalesce((probe_status < 400) & (F.substring(probe_body, 1, 2000) == F.substring(body, 1, 2000)), F.lit(False))
    return own & ~words.rlike(EMPLOYMENT) & words.rlike(ADMISSION) & ~template


def admission_links(pages: DataFrame, key: str, url: str = "url", page: str = "page") -> DataFrame:
    """(key, url, label, priority) of the best admission link of each page: of the page's own site, not
    the page itself, not an employment page; applying comes before other words, then the first."""
    from ..functions.text import host, same_site

    links = pages.select(key, F.col(url).alias("_page"), F.posexplode(F.col(f"{page}.links")).alias("pos", "link"))
    links = links.select(key, "_page", "pos", F.col("link.label").alias("label"), resolved(F.col("_page"), F.col("link.url")).alias("url"))
    text = F.concat_ws(" ", "label", "url")
    links = links.where(same_site(host(F.col("url")), host(F.col("_page"))) & (path_of(F.col("url")) != path_of(F.col("_page"))))
    links = links.where(~text.rlike(EMPLOYMENT) & text.rlike(ADMISSION)).withColumn("priority", F.when(text.rlike(r"(?i)\bapply\b"), 2).otherwise(1))
    best = links.groupBy(key).agg(F.min_by(F.struct("url", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Apply")).alias("label"), "priority"), F.struct((-F.col("priority")).alias("p"), "pos")).alias("b"))
    return best.select(key, "b.*")


def own_site(found: DataFrame, key: str, name: str, url: str, position: str, blocked: DataFrame, pattern: str, ending: str = ".edu") -> DataFrame:
    """(key, url): of the addresses found for a name, in order, the one that is taken for its own site.

    Hosts of `blocked` (host) and below, and hosts that the pattern matches, are none. The host's
    letters must hold a word of the name of three letters or more that tells it from others. A host
    with the preferred ending comes first, then the earlier address."""
    from ..functions.text import host, tokens

    words = F.filter(F.array_distinct(tokens(F.col(name))), lambda w: (F.length(w) > 2) & ~w.isin(*NAME_STOP))
    rows = found.select(F.col(key), F.col(url).alias("url"), F.col(position).alias("_pos"), words.alias("_words"), host(F.col(url)).alias("_host")).where("_host <> ''")
    # A host is at most as deep as its labels: each of its endings is looked up, no pair is tried.
    labels = F.split("_host", "\\.")
    ends = rows.withColumn("_end", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    shut = ends.join(blocked.select(F.col("host").alias("_end")).distinct(), "_end", "left_semi").select(key, "_pos").distinct()
    rows = rows.join(shut, [key, "_pos"], "left_anti").where(~F.col("_host").rlike(pattern))
    letters = F.regexp_replace("_host", "[^a-z0-9]", "")
    rows = rows.where(F.exists("_words", lambda w: F.contains(letters, w)))
    best = rows.groupBy(key).agg(F.min_by("url", F.struct((~F.col("_host").endswith(ending)).alias("no"), "_pos")).alias("url"))
    return best.select(key, "url")
