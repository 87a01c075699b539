"""URL filter: a trie over reversed host labels, then path segments; the deepest rule decides.

The trie holds the rules, not the urls. Up to `MOST_RULES` rules it is broadcast to the tasks; a
larger list is looked up by a join on (host suffix, path prefix) instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh

#: Above so many rules (about 100 bytes each) the join is used.
MOST_RULES = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty where it is null or has no `://`."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    plain = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(plain, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(plain, r"^[^/]*([\s\S]*)$", 1)


def grown(rules: Iterable[tuple[str, str, str]]) -> dict:
    """The trie. Nodes are dicts: an edge of the host is a label, one of the path ('/', segment).
    None leads to the path tails that end a rule at the node: tail -> (rule, verdict)."""
    root: dict = {}
    for host, path, verdict in sorted(rules):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.setdefault(("/", segment), {})
        tails = node.setdefault(None, {})
        if tails.get(tail, ("", "allow"))[1] != "block":  # of equal rules, block holds
            tails[tail] = (f"{host}{path}", verdict)
    return root


def found(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule that fits with most host labels, then the longest path, and its verdict."""
    segments, best, node = path.split("/"), None, root
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = _below(node, segments) or best
    return best


def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for i, segment in enumerate(segments):
        fit = [t for t in node.get(None, ()) if segment.startswith(t)]
        if fit:
            best = node[None][max(fit, key=len)]
        node = node.get(("/", segment)) if i + 1 < len(segments) else None
        if node is None:
            break
    return best


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """Every column of `pages`, and a struct `judged` of host, path, rule and verdict; a column of the
    input of that name is replaced.

    `rules`: host, path, verdict (allow or block). A rule fits its host and all subdomains where the
    url's path starts with the rule's. Most host labels win, then the longest path; of two equal
    rules, block. Without a fitting rule, rule is null and the verdict is `default`. A null url, or
    one without `://`, has an empty host and path, which no rule fits but one with an empty host.
    Rules with a null host or verdict are ignored; a null path counts as empty.
    """
    rules = rules.where("host is not null and verdict is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    host, path = url_parts(F.col(f"`{url}`"))
    if not fits(rules, most_rules):
        return _joined(pages, rules, host, path, default)
    trie = pages.sparkSession.sparkContext.broadcast(grown(tuple(r) for r in rules.collect()))

    @F.pandas_udf("rule string, verdict string")
    def walk(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in frames:
            hits = [found(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    h, p, w = fresh(pages, "h", "p", "w")
    return (
        pages.withColumns({h: host, p: path})
        .withColumn(w, walk(h, p))
        .withColumn("judged", F.struct(F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{w}.rule").alias("rule"), F.col(f"{w}.verdict").alias("verdict")))
        .drop(h, p, w)
    )


def _joined(pages: DataFrame, rules: DataFrame, host: Column, path: Column, default: str) -> DataFrame:
    """The same by a join: each distinct (host, path) is looked up by its host suffixes, and rules
    of a suffix are narrowed by the path's prefixes of the lengths that rules have."""
    h, p, best = fresh(pages, "h", "p", "best")
    pages = pages.withColumns({h: host, p: path})
    lengths = rules.groupBy(F.length("path").alias("n")).count().select("n")
    parts = F.split(F.col(h), "\\.")
    probes = (
        pages.select(h, p)
        .distinct()
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
        .withColumn("suffix", F.array_join(F.slice(parts, -F.col("depth"), F.col("depth")), "."))
        .join(F.broadcast(lengths), F.col("n") <= F.length(p))
        .withColumn("prefix", F.substring(F.col(p), F.lit(1), F.col("n")))
    )
    r = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("v"))
    found = (
        probes.join(r, (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
        .groupBy(h, p)
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("v").alias("verdict")), F.struct("depth", "n")).alias(best))
    )
    return (
        pages.join(found, [h, p], "left")
        .withColumn("judged", F.struct(F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict")))
        .drop(h, p, best)
    )
