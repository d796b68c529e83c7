"""Tables that jobs write in order to cut lineage: in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows (of a few numbers each) that a join may broadcast; some 10 MB.
BROADCAST_ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(column: str) -> str:
    """A column's name as an expression, whatever stands in it."""
    return "`" + column.replace("`", "``") + "`"


def few(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
