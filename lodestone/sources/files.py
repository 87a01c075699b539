"""File sources: delimited text, zipped or not, triples, optional tables, fingerprints, sheets, JSON by key."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at the path, or an empty one of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Headed delimited text. A byte-order mark goes, names and values are trimmed, blanks are null.
    Without a schema every column is text: no pass over the data to guess types."""
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    frame = reader.schema(schema).option("enforceSchema", False).csv(path) if schema else reader.csv(path)
    return frame.toDF(*[c.lstrip("﻿").strip() for c in frame.columns])


def zipped_text(spark: SparkSession, path: str, columns: list[str], sep: str = ",", member: str = r"\.(csv|txt)$") -> DataFrame:
    """Rows of the first matching member of each archive, columns found by their header names; bytes
    that are not UTF-8 are replaced. An archive is one task's work, read line by line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv as reader

        for frame in frames:
            for data in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = next((n for n in z.namelist() if re.search(member, n)), None)
                    if name is None:
                        continue
                    rows, held = reader.DictReader(io.TextIOWrapper(z.open(name), "utf-8-sig", "replace"), delimiter=sep), []
                    rows.fieldnames = [c.strip() for c in rows.fieldnames or []]
                    for row in rows:
                        held.append([(row.get(c) or "").strip() for c in columns])
                        if len(held) >= 10_000:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, kind) of N-Triples lines, kind being iri, blank or literal; comments and lines of other
    form are left out. Literals lose their escapes, and their language or type."""
    node = r"<([^>]*)>|(_:[\w.-]+)"
    line = rf'^\s*(?:{node})\s+<([^>]*)>\s+(?:{node}|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    got = spark.read.text(path).where(F.regexp_like("value", F.lit(line)))
    part = lambda k: F.regexp_extract("value", line, k)
    # A backslash is set aside first, so that the n of an escaped backslash before an n stays one.
    plain = F.regexp_replace(part(6), r"\\\\", "\x00")
    for a, b in (("n", "\n"), ("t", "\t"), ("r", "\r"), ('"', '"')):
        plain = F.regexp_replace(plain, rf"\\{a}", b)
    plain = F.replace(plain, F.lit("\x00"), F.lit("\\"))
    kind = F.when(F.regexp_like("value", F.lit(rf"^\s*(?:{node})\s+<[^>]*>\s+<")), "iri").when(part(5) != "", "blank").otherwise("literal")
    rows = got.select(F.concat(part(1), part(2)).alias("s"), part(3).alias("p"), part(4).alias("i"), part(5).alias("b"), plain.alias("l"), kind.alias("kind"))
    return rows.select("s", "p", F.when(F.col("kind") == "iri", F.col("i")).when(F.col("kind") == "blank", F.col("b")).otherwise(F.col("l")).alias("o"), "kind")


def column_number(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet(data: bytes) -> Iterator[list[str]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{ns}si":
                    shared.append("".join(x.text or "" for x in e.iter(f"{ns}t")))
                    e.clear()
        name = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/"))[0]
        for _, e in ElementTree.iterparse(z.open(name)):
            if e.tag != f"{ns}row":
                continue
            row: list[str] = []
            for c in e.iter(f"{ns}c"):
                at = column_number(re.match("[A-Za-z]+", c.get("r")).group()) if c.get("r") else len(row)
                row += [""] * (at + 1 - len(row))
                v, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                text = "".join(x.text or "" for x in inline.iter(f"{ns}t")) if inline is not None else (v.text or "" if v is not None else "")
                row[at] = shared[int(text)] if c.get("t") == "s" else text
            e.clear()
            yield row


def xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first sheet's rows as text, columns found by the first row's names; a missing one raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = _sheet(data)
                head = next(rows, [])
                lacking = [c for c in columns if c not in head]
                if lacking:
                    raise ValueError(f"the sheet lacks {lacking}")
                at, held = [head.index(c) for c in columns], []
                for row in rows:
                    held.append([row[i] if i < len(row) else "" for i in at])
                    if len(held) >= 1000:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


class Later(Exception):
    """Raised by a fetcher that is told to come back: after so many seconds, if it knows."""

    def __init__(self, seconds: float | None = None):
        super().__init__("asked to come back later")
        self.seconds = seconds


class Spent(Exception):
    """Raised by a fetcher whose quota is used up: nothing more is asked for."""


def fetched(keys: DataFrame, key: str, fetch: Callable[..., str | None], tries: int = 3, kinds: list[str] | None = None, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, stop: str | None = None) -> DataFrame:
    """(key, kind, payload, error) by a fetcher that is passed in; what fails after some tries is a row
    with its error. With kinds it is called as fetch(key, kind), and each key has a row a kind.

    Between tries a task waits `wait` seconds, twice as long each time, or as long as `Later` says.
    After `Spent` a task asks for nothing more: its other rows have the error 'Spent'. With `stop`, the
    address of a file in a shared folder, it puts that file there, and all tasks, which look for it
    before they ask, end alike. For loading a table, never inside a query."""

    def once(args: tuple) -> tuple[str | None, str | None, bool]:
        error = None
        for n in range(tries):
            try:
                return fetch(*args), None, False
            except Spent:
                return None, "Spent", True
            except Exception as e:  # the fetcher is the caller's: any failure is that row's
                error = f"{type(e).__name__}: {e}"
                if n + 1 < tries:
                    sleep(e.seconds if isinstance(e, Later) and e.seconds is not None else wait * 2**n)
        return None, error, False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .scratch import put, there

        spent = False
        for frame in frames:
            out = []
            for k in frame[key]:
                for kind in kinds or [None]:
                    payload, error = None, "Spent"
                    spent = spent or (stop is not None and there(stop))
                    if not spent:
                        payload, error, spent = once((k,) if kind is None else (k, kind))
                        if spent and stop is not None:
                            put(stop, b"")
                    out.append((k, kind, payload, error))
            yield pd.DataFrame(out, columns=[key, "kind", "payload", "error"])

    return keys.select(F.col(key).cast("string").alias(key)).mapInPandas(run, f"{key} string, kind string, payload string, error string")


def loaded(keys: DataFrame, key: str, fetch: Callable[..., str | None], where: str, kinds: list[str] | None = None, retry: int = 3, **options) -> tuple[DataFrame, bool]:
    """A load that stops and goes on. Attempts are kept at `where`, a shared folder: a run asks only for
    pairs of key and kind that have neither an answer nor `retry` failures there, and adds its own. Once a
    fetcher says `Spent`, no task of the run asks for more, and what was not asked for is left to the
    next run. Gives (key, kind, payload, error), one row a pair that was ever asked for: its answer, or
    the last error; and whether the quota was used up."""
    spark = keys.sparkSession
    wanted = keys.select(F.col(key).cast("string").alias(key)).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))) if kinds else F.lit(None).cast("string"))
    schema = f"`{key}` string, kind string, payload string, error string, run bigint"
    attempts, none = f"{where}/attempts", spark.createDataFrame([], schema)
    from .snapshots import exists

    before = spark.read.schema(schema).parquet(attempts) if exists(spark, attempts) else none
    pair = [key, F.coalesce("kind", F.lit("")).alias("_kind")]
    tried = before.groupBy(*pair).agg(F.count_if(F.col("error").isNull()).alias("answers"), F.count("*").alias("n"))
    done = tried.where((F.col("answers") > 0) | (F.col("n") >= retry)).select(key, "_kind")
    left = wanted.withColumn("_kind", F.coalesce("kind", F.lit(""))).join(done, [key, "_kind"], "left_anti")
    run = (before.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]) + 1
    stop = f"{where}/stops/{run:06d}"
    asked = fetched(left.select(F.to_json(F.struct(F.col(key).alias("k"), "kind"), {"ignoreNullFields": "false"}).alias("pair")), "pair", _Pair(fetch), stop=stop, **options)
    pair_of = F.from_json("pair", "k string, kind string")
    asked = asked.where("error IS NULL OR error <> 'Spent'").select(pair_of["k"].alias(key), pair_of["kind"].alias("kind"), "payload", "error", F.lit(run).cast("bigint").alias("run"))
    asked.write.mode("append").parquet(attempts)
    every = spark.read.schema(schema).parquet(attempts)
    best = F.max_by(F.struct("kind", "payload", "error"), F.struct(F.col("error").isNull(), "run")).alias("b")
    return every.groupBy(*pair).agg(best).select(key, "b.*"), exists(spark, stop)


class _Pair:
    """A fetcher of (key, kind) called with both as one text."""

    def __init__(self, fetch: Callable[..., str | None]):
        self.fetch = fetch

    def __call__(self, pair: str) -> str | None:
        x = json.loads(pair)
        return self.fetch(x["k"]) if x["kind"] is None else self.fetch(x["k"], x["kind"])


def write_sheets(rows: DataFrame, columns: list[str], where: str) -> int:
    """The rows as workbooks of one sheet, a file a partition; the number of files."""
    from .scratch import put

    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'

    def cell(value: object) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'

    def book(table: Iterator[list]) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", head + "".join(f"<row>{''.join(map(cell, row))}</row>" for row in table) + "</sheetData></worksheet>")
        return held.getvalue()

    return _one_file_each(rows.select(*columns), where, "xlsx", lambda frames: book([columns, *[list(r) for f in frames for r in f.itertuples(index=False)]]), put)


def write_zipped(rows: DataFrame, columns: list[str], where: str, sep: str = ",", member: str = "data.csv", encode: str = "utf-8-sig") -> int:
    """The rows as archives of one headed delimited text, a file a partition; the number of files."""
    import csv as writer

    from .scratch import put

    def archive(frames: Iterator[pd.DataFrame]) -> bytes:
        text, held = io.StringIO(), io.BytesIO()
        out = writer.writer(text, delimiter=sep)
        out.writerow(columns)
        for frame in frames:
            out.writerows(frame.itertuples(index=False))
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member, text.getvalue().encode(encode))
        return held.getvalue()

    return _one_file_each(rows.select(*columns), where, "zip", archive, put)


def _one_file_each(rows: DataFrame, where: str, ending: str, make: Callable[[Iterator[pd.DataFrame]], bytes], put: Callable[[str, bytes], None]) -> int:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        put(f"{where}/part-{TaskContext.get().partitionId():06d}.{ending}", make(frames))
        yield pd.DataFrame({"n": [1]})

    return rows.mapInPandas(run, "n int").count()
