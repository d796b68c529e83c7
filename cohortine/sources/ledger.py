"""Resumable work: what is already done, what is stale, which block wins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.sources import files


def run_grid(configs: DataFrame, seeds: Sequence[int], folds: int) -> DataFrame:
    """Every (seed, fold) cell of every configuration."""
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    return configs.select("*", seed).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str] = tuple(V.RUN_KEYS)) -> DataFrame:
    """Planned cells without a finished run; null keys are equal to null keys."""
    d = done.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return planned.join(d, on, "left_anti")


def stale(cases: DataFrame, built: DataFrame, key: str, version: str) -> DataFrame:
    """Cases without an output of the current version."""
    return cases.join(built.where(F.col("version") == version).select(key), key, "left_anti")


def rebuild(cases: DataFrame, path: str, block: str, key: str, version: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table at ``path`` up to ``version`` and tell which blocks were built anew.

    The table is partitioned by ``block`` and carries the version of each row. A block is stale if a case of it has no row of
    the current version, or if it holds a row of a case that is gone. ``build`` turns cases into rows (block, key, ...);
    it sees the cases of stale blocks only, and only their folders are replaced. A block whose cases are all gone is emptied.
    """
    spark = cases.sparkSession
    schema = build(cases.limit(0)).withColumn("version", F.lit(version)).schema
    wanted = cases.select(block, key).distinct()
    if files.exists(spark, path):
        built = spark.read.schema(schema).parquet(path)
        current = built.where(F.col("version") == version).select(block, key).distinct()
        blocks = wanted.join(current, [block, key], "left_anti").select(block).union(built.join(wanted, [block, key], "left_anti").select(block))
    else:
        blocks = wanted.select(block)
    listed = f"{path.rstrip('/')}.stale-{uuid.uuid4().hex}"
    blocks.distinct().write.parquet(listed)  # the list must not change while the table does
    stale_blocks = spark.read.parquet(listed)
    rows = build(cases.join(stale_blocks, block, "left_semi")).withColumn("version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)
    gone = stale_blocks.join(wanted, block, "left_anti")
    for row in gone.toLocalIterator():  # folders, as a listing of the table would return them
        files.remove(spark, f"{path.rstrip('/')}/{block}={quote(str(row[0]), safe=' ')}")
    return stale_blocks


def append_runs(rows: DataFrame, path: str) -> None:
    """Appends run rows, one folder per configuration and task, so that readers prune."""
    rows.write.mode("append").partitionBy("config", "task").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run rows; tasks with different metrics share one table."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def merge_block(docs: DataFrame, updates: DataFrame, key: str, block: str, protected: str) -> DataFrame:
    """New version of documents: an update replaces a block unless the block has a protected source.

    Both tables have the key and the struct ``block`` with a field ``source``.
    """
    u = updates.select(key, F.col(block).alias("__new"))
    keep = F.coalesce(F.col(f"{block}.source") == protected, F.lit(False))
    merged = F.when(keep | F.col("__new").isNull(), F.col(block)).otherwise(F.col("__new"))
    return docs.join(u, key, "left").withColumn(block, merged).drop("__new")


def document_text(blocks: Mapping[str, Column]) -> Column:
    """JSON text of named blocks; empty fields are written, not dropped."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in blocks.items()]), {"ignoreNullFields": "false"})
