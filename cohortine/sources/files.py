"""Names of files and folders in whatever file system holds them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str) -> object:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def of(spark: SparkSession, path: str) -> tuple[object, str]:
    """The file system of a path, and the path."""
    return at(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()), path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, top = of(spark, path)
    return fs.exists(at(spark, top))


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another. The old one is moved aside first and goes last, so a failure between leaves one
    of the two complete."""
    fs, top = of(spark, target)
    old = f"{top}.replaced"
    fs.delete(at(spark, old), True)
    if fs.exists(at(spark, top)) and not fs.rename(at(spark, top), at(spark, old)):
        raise OSError(f"cannot move {top}")
    if not fs.rename(at(spark, source), at(spark, top)):
        raise OSError(f"cannot move {source}")
    fs.delete(at(spark, old), True)


def remove(spark: SparkSession, path: str) -> None:
    fs, top = of(spark, path)
    fs.delete(at(spark, top), True)


def value_of(folder: str) -> str:
    """The value in the name of a partition folder."""
    return unquote(folder.split("=", 1)[1])
