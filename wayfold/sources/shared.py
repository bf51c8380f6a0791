"""Reading tables, and cutting lineage through the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> str:
    """The path of a new Parquet table in the shared folder that holds df."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(like: DataFrame, *paths: str) -> DataFrame:
    """The rows of all saved tables at paths, whose columns are those of like.

    However many there are, a plan has one scan of them: each scan more is one
    more copy of the job's settings that the driver holds and sends.
    """
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: short plans, and a lost executor costs a re-read only."""
    return stored(df, saved(df, name))


def arrow_files(df: DataFrame, name: str) -> list[str]:
    """Paths of Arrow files in the shared folder that hold df, one for each task that has rows; the driver sees the paths only.

    They are for tasks that look rows up where no join would do, and so the
    folder must be mounted on all machines; another scheme is an error.
    """
    url = urlparse(shared_folder(df.sparkSession))
    if url.scheme not in ("", "file"):
        raise ValueError(f"files are memory-mapped and need a shared folder mounted on all machines, not {url.scheme}:")
    folder = f"{url.path}/{name}-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        # what an attempt that failed has left isn't among the paths
        path, writer = f"{folder}/{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            writer = writer or pa.ipc.new_file(path, batch.schema)
            writer.write_batch(batch)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return [r.path for r in df.mapInArrow(write, "path string").collect()]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over the session's number of shuffle tasks, none of them put together.

    A written table takes few bytes a row, so a task that reads it holds very
    many rows: what groups or sorts them goes behind this.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
