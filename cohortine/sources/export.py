"""Public copies: dropped columns, hashed ids, a manifest and a gate before writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.functions.scalars import salted_hash
from cohortine.sources import files


def public_projection(
    df: DataFrame, hashed: Mapping[str, str], salt: str, private: Sequence[str] = tuple(V.PRIVATE_COLUMNS)
) -> DataFrame:
    """Identifying columns dropped, ids replaced by salted hashes under their new names."""
    for column, name in hashed.items():
        df = df.withColumn(name, salted_hash(F.col(column), salt))
    return df.drop(*[c for c in (*private, *hashed) if c in df.columns])


def manifest(df: DataFrame, histograms: Sequence[str], unit: str, case: str) -> DataFrame:
    """Counts of a cohort and one histogram per named column, as rows (section, key, n).

    One pass: every row contributes one entry per histogram, counted before the shuffle.
    """
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(h).alias("section"), F.coalesce(F.col(h).cast("string"), F.lit("missing")).alias("key")) for h in histograms]
        )
    )
    hist = df.select(cells.alias("c")).groupBy("c.section", "c.key").agg(F.count(F.lit(1)).alias("n"))
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(unit).alias("n_patients"), F.countDistinct(case).alias("n_cases")
    )
    names = ["n_rows", "n_patients", "n_cases"]
    rows = F.inline(F.array(*[F.struct(F.lit("cohort").alias("section"), F.lit(n).alias("key"), F.col(n).alias("n")) for n in names]))
    return totals.select(rows).unionByName(hist)


def manifest_document(rows: DataFrame) -> DataFrame:
    """The manifest as one nested row; it holds one entry per distinct value of a vocabulary."""
    entry = F.struct("key", "n")
    maps = rows.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("counts"))
    return maps.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("counts"))))).alias("manifest"))


def gate(findings: DataFrame) -> DataFrame:
    """One row: number of findings and whether an export may go on."""
    return findings.agg(F.count(F.lit(1)).alias("n_findings")).withColumn("clean", F.col("n_findings") == 0)


def gated_export(df: DataFrame, scan: Callable[[DataFrame], DataFrame], target: str) -> dict[str, int | bool]:
    """Publish rows at ``target`` only if nothing is found in them; what stands there stays until then.

    The rows are written once, beside the target, and the scan reads what was written, so what is published is what was
    scanned. On a finding the staged rows go and the target is as before. Tells n_rows, n_findings and written.
    """
    spark = df.sparkSession
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    try:
        rows = spark.read.schema(df.schema).parquet(staged)
        n_findings = scan(rows).count()
        n_rows = rows.count()
        if n_findings == 0:
            files.replace(spark, staged, target)
    finally:
        files.remove(spark, staged)
    return {"n_rows": n_rows, "n_findings": n_findings, "written": n_findings == 0}
