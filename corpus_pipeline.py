"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the docs of the next. All but the last return the columns of docs; the stages decide on `doc_id` and
`text`, other columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortine.llm import decontaminate, jaccard, language, line_dedup, packing
from cohortine.llm.queries import table
from cohortine.llm.scratch import few, quoted, saved

#: A document whose best language has no larger posterior probability than this is in none of the learned languages.
LEAST_SCORE = 0.5


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows with one of these doc_ids, all columns as they are, whatever their names. A null doc_id stays."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled rows of the table; undetermined ones go, null, empty and
    letterless texts among them. Rows that repeat a doc_id are judged one by one. No documents give none."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(docs.where(~held_out))
    return language.keep_identified(docs, model, LEAST_SCORE)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated lines; documents of which nothing is left go, and so do null and blank ones. A row with a null
    doc_id keeps its lines."""
    return line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"\S"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Rows that repeat a doc_id stay or go
    together; those without doc_id, words or text stay."""
    groups = jaccard.similar_documents(docs)
    copies = few(saved(groups.where("component_id <> doc_id").select("doc_id")))
    return without(docs, copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. An empty benchmark leaves all; rows that repeat a doc_id stay or go
    together, and those without one stay."""
    _, hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, few(saved(hits.select("doc_id").distinct())))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed; null and blank texts have no piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Code lengths, edit distances and the choice of boundaries are not expressible in SQL; tests hold each stage's operator
#: against brute force, and the stages against what must hold after them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
