"""Labels in texts as links: many labels, from a table, in many texts.

A text is scanned from the left; where labels begin the longest is taken, and the scan goes on behind
it, so links never overlap. Case is put aside letter by letter. Labels up to a checked size travel to the
tasks as one table, from which each Python worker builds one automaton; a larger table is met by a join:
a label whose rarest word a text lacks is not in it, so each text is sent the few labels that can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Characters of labels and addresses that are broadcast.
MOST_CHARS = 8_000_000
_BUILT: dict[str, Labels] = {}


def _low(text: str) -> str:
    """Lower case, a letter for a letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Labels:
    """Labels with their addresses, ready to be looked for."""

    def __init__(self, pairs: list[tuple[str, str]], whole: bool):
        import ahocorasick

        self.whole, self.find = whole, ahocorasick.Automaton()
        for label, url in sorted((p for p in pairs if p[0] and p[1] is not None), reverse=True):
            self.find.add_word(_low(label), (len(label), url))  # of labels that differ by case the least stays
        if len(self.find):
            self.find.make_automaton()

    def link(self, text: str | None) -> str | None:
        if not text or not len(self.find):
            return text
        best: dict[int, tuple[int, str]] = {}
        low = _low(text)
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        for last, (size, url) in self.find.iter(low):
            first = last + 1 - size
            if self.whole and (word(first - 1) or word(last + 1)):
                continue
            if first not in best or size > best[first][0]:
                best[first] = size, url
        out, at = [], 0
        for first in sorted(best):
            if first >= at:
                size, url = best[first]
                out += [text[at:first], "[", text[first : first + size], "](", url, ")"]
                at = first + size
        return "".join([*out, text[at:]])


def autolinked(rows: DataFrame, text: str, labels: DataFrame, key: list[str], whole: bool = True, most: int = MOST_CHARS) -> DataFrame:
    """The rows with each label in their text as a link, [words](address). labels: (label, url); of equal
    labels, case aside, the least pair counts; empty ones and those without an address are none. whole:
    only where no letter, digit or underscore stands beside; without it labels must be few enough to
    broadcast, and so must those that hold no word. key: columns that with the text tell rows apart,
    used where the labels are more; equal ones are then linked once and alike."""
    given = labels.select("label", "url").where("label <> '' AND url IS NOT NULL").distinct()
    size = given.agg(F.coalesce(F.sum(F.length("label") + F.length("url")), F.lit(0))).first()[0]
    if size <= most:
        held, mark = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in given.collect()]), uuid4().hex

        @F.pandas_udf("string")
        def link(texts: pd.Series) -> pd.Series:
            if mark not in _BUILT:
                _BUILT.clear()
                _BUILT[mark] = Labels(held.value, whole)
            return texts.map(_BUILT[mark].link)

        return rows.withColumn(text, link(text))
    if not whole:
        raise ValueError("labels within words are found by scanning alone, and these are too many to broadcast")
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(F.col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    of_label = given.select("label", "url", F.explode_outer(words("label")).alias("w"))
    often = of_label.groupBy("w").agg(F.count("*").alias("n"))
    rarest = of_label.join(often, "w", "left").groupBy("label", "url").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    signs = rarest.where("w IS NULL").limit(most // 2 + 1000).select("label", "url").collect()
    if len(signs) == most // 2 + 1000:
        raise ValueError("too many labels without a word")
    anywhere = [tuple(r) for r in signs]
    numbered = rows.withColumn("_row", F.xxhash64(*key, text))
    texts = numbered.select("_row", text).dropDuplicates(["_row"])
    near = texts.select("_row", F.explode(words(text)).alias("w")).join(rarest.where("w IS NOT NULL"), "w")
    near = near.groupBy("_row").agg(F.collect_set(F.struct("label", "url")).alias("_labels"))

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [Labels(anywhere + [(x["label"], x["url"]) for x in ([] if ls is None else ls)], whole).link(t) for t, ls in zip(frame[text], frame["_labels"])]
            yield pd.DataFrame({"_row": frame["_row"], "_linked": done})

    made = texts.join(near, "_row", "left" if anywhere else "inner").select("_row", text, "_labels").mapInPandas(linked, "_row bigint, _linked string")
    return numbered.join(made, "_row", "left").withColumn(text, F.coalesce("_linked", text)).select(*rows.columns)
