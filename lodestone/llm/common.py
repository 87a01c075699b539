"""Column expressions and small helpers that several operators of this package use."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go with it.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are what stands between these characters; the same set in Java, RE2 and Python.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like those wanted which no column of the frame has, case aside."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def under(frame: DataFrame, id: str) -> DataFrame:
    """The frame with its column `id` under the caller's name; a result column that has that name, case
    aside, gets an underscore before its own."""
    out, taken = [F.col("id").alias(id)], {id.lower(), *(c.lower() for c in frame.columns if c != "id" and c.lower() != id.lower())}
    for c in frame.columns:
        if c == "id":
            continue
        name = c
        while name.lower() == id.lower() or (name != c and name.lower() in taken):
            name = "_" + name
        taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return frame.select(*out)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder, which every executor reaches."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one is set under /tmp only where a local session has none, as in tests. On
    a cluster without the setting this raises: its executors share no folder of their own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/lodestone-checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and outlives executors."""
    spark = frame.sparkSession
    path = shared_dir(spark, label)
    with tidy(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends, as its result is kept elsewhere."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def fits(frame: DataFrame, most: int) -> bool:
    """Whether the frame has at most so many rows: a bounded count, for the choice to broadcast."""
    return frame.limit(most + 1).count() <= most


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
