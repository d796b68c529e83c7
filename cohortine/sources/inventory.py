"""File inventories and readers that keep where a row came from."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortine.sources import files

INVENTORY = "root_id string, collection string, folder string, file_path string, file_name string, file_size bigint, read_error string"


def path_fields(path: Column) -> dict[str, Column]:
    """Name and parent folder of a path."""
    return {
        "file_name": F.regexp_extract(path, r"([^/]+)$", 1),
        "folder": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
    }


def list_files(
    spark: SparkSession, roots: Sequence[Mapping[str, str]], skip_name: str = "DICOMDIR"
) -> tuple[DataFrame, list[str]]:
    """One row per file under every root but one file name, and the roots that are missing.

    Only metadata is listed; the content column is pruned, so ``read_error`` stays empty
    until a reader of the content fills it. The file source itself leaves out files of
    length zero. A root that does not exist is reported and skipped.
    """
    parts, missing = [], []
    for root in roots:
        try:
            found = (
                spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root["path"])
            )
        except AnalysisException:
            missing.append(root["path"])
            continue
        fields = path_fields(F.col("path"))
        parts.append(
            found.select(
                F.lit(root["id"]).alias("root_id"),
                F.lit(root["collection"]).alias("collection"),
                fields["folder"].alias("folder"),
                F.col("path").alias("file_path"),
                fields["file_name"].alias("file_name"),
                F.col("length").alias("file_size"),
                F.lit(None).cast("string").alias("read_error"),
            ).where(F.col("file_name") != skip_name)
        )
    if not parts:
        return spark.createDataFrame([], INVENTORY), missing
    return reduce(lambda a, b: a.unionByName(b), parts), missing


def union_roots(sources: Mapping[str, tuple[str, DataFrame | None]]) -> DataFrame:
    """Union of tables with their root and collection; a missing one (None) is skipped."""
    parts = [
        df.withColumn("root_id", F.lit(root)).withColumn("collection", F.lit(collection))
        for root, (collection, df) in sources.items()
        if df is not None
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_keys(file_name: Column) -> dict[str, Column]:
    """Run keys from the end of a prediction file name; configuration names may hold "_s"."""
    stem = F.regexp_replace(file_name, r"\.csv$", "")
    pattern = r"^(.*)_(has_stone|size3|zone)_s(\d+)_f(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))
    return {
        "config": part(1),
        "task": part(2),
        "seed": part(3).try_cast("int"),
        "fold": part(4).try_cast("int"),
    }


def write_predictions(rows: DataFrame, path: str, name: str) -> None:
    """One CSV file for each value of ``name``, called so, in one folder."""
    rows.repartition(name).write.partitionBy(name).csv(f"{path}/_parts", header=True, escape='"')
    spark = rows.sparkSession
    fs, top = files.of(spark, path)
    for folder in fs.listStatus(files.at(spark, f"{top}/_parts")):
        if folder.isDirectory():
            stem = files.value_of(folder.getPath().getName())
            for number, part in enumerate(p for p in fs.listStatus(folder.getPath()) if p.getPath().getName().endswith(".csv")):
                fs.rename(part.getPath(), files.at(spark, f"{top}/{stem}{f'-{number}' if number else ''}.csv"))
    fs.delete(files.at(spark, f"{top}/_parts"), True)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction files with the run keys of their names. Files whose name holds no run keys are left out."""
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    named = raw.withColumn("__f", F.col("_metadata.file_name"))
    for name, value in run_keys(F.col("__f")).items():
        named = named.withColumn(name, value)
    return named.drop("__f").where("task IS NOT NULL")


# ------------------------------------------------------------------ lines of files
def _line_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line): the lines of text files; ``at`` ascends inside a split of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    file, split = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return lines.select(file, split, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def number_lines(rows: DataFrame, name: str) -> DataFrame:
    """Adds the number of each row inside its file, from 0: counts of the splits before it, and its rank in its own."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    return rows.withColumn(name, own).join(counts, ["file", "split"]).withColumn(name, F.col("before") + F.col(name)).drop("before")


def read_sheet(spark: SparkSession, path: str, key: str, skip_rows: int = 0) -> DataFrame:
    """An exported sheet (one CSV file or several of one header) whose header is line ``skip_rows``, as text columns.

    Adds source_row, the line of the row in its file, and row_index, its number among the rows of its file that have a key;
    others are dropped. A file is read in splits and numbered by their counts, so no task needs all of it. Cells hold no
    line breaks. Header names keep their blanks; a repeated name gets a number, an empty one its place.
    """
    lines = number_lines(_line_rows(spark, path), "source_row")
    head = lines.where(F.col("source_row") == skip_rows).agg(F.min("line")).first()[0]
    if head is None:
        return spark.createDataFrame([], f"source_row bigint, row_index bigint, `{key}` string")
    names: list[str] = []
    for place, word in enumerate(next(csv.reader([head.lstrip("\ufeff")]))):
        word = word or f"column{place}"
        names.append(word if word not in names else f"{word}.{sum(n.split('.')[0] == word for n in names)}")
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = F.from_csv("line", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("c")
    rows = lines.where(F.col("source_row") > skip_rows).select("file", "split", "at", "source_row", cells)
    kept = number_lines(rows.where(F.col(f"c.`{key}`").isNotNull()), "row_index")
    return kept.select("source_row", "row_index", *(F.col(f"c.`{n}`").alias(n) for n in names))


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of different headers as one table of text columns with ``file``; a column that a file lacks is null.

    One pass over the lines finds each file's header and whether a quoted cell of it holds a line break. Files are read by
    header, those without such cells in splits. The distinct headers (of at most ``len(files)``) come to the driver, as
    the list of files does.
    """
    lines = _line_rows(spark, path)
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    heads = lines.groupBy("file").agg(
        F.min_by("line", F.struct("split", "at")).alias("head"), F.bool_or(odd).alias("broken"),
    ).groupBy("head", "broken").agg(F.collect_list("file").alias("files"))
    parts = []
    for r in sorted(heads.collect(), key=lambda r: (r.head, r.broken)):
        names = next(csv.reader([r.head.lstrip("\ufeff")]))
        raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(r.files, header=True, multiLine=r.broken, escape='"', emptyValue="", nullValue="\\N")
        parts.append(raw.select("*", F.col("_metadata.file_name").alias("file")))
    if not parts:
        return spark.createDataFrame([], "file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header; embedded quotes and line breaks survive."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, emptyValue="", nullValue="\\N")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=True, escape='"', emptyValue="", nullValue="\\N",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def scratch_folder(spark: SparkSession) -> str:
    """A new folder inside the shared folder the cluster names; only a local session may do without one."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/cohortine-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp(prefix="cohortine-")
