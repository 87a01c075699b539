"""Folders for tables that are written to be read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; under /tmp only where a
    local session has no such setting, as in tests. On a cluster without the setting this raises."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/lodestone-scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in a new shared folder: cuts lineage and outlives executors."""
    where = folder(frame.sparkSession, label)
    frame.write.parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


def put(url: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a task that is lost or run twice leaves no part."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def there(url: str) -> bool:
    """Whether a file is there, as a task sees it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    return store.get_file_info(path).type != fs.FileType.NotFound
