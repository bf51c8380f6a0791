"""Tables on the way to a result, and columns that operators read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.shared import shared_folder, table, written

__all__ = ["Scratch", "drop_written", "id_and_text", "shared_folder", "table", "written"]


class Scratch:
    """Tables that written() makes on the way to a result, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """The result, written; the tables before it are deleted."""
        out = written(df, name)
        drop_written(self.spark, f"{shared_folder(self.spark)}/{self.folder}")
        return out


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made, through Hadoop's file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string), nothing else; other columns of docs cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
