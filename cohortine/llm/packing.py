"""Length-bucketed packing with optimal bucket boundaries.

Texts are cut into pieces of at most MAX_LEN words, so that lengths are bounded by that parameter and the histogram of
all lengths has at most MAX_LEN entries. Dynamic programming over it chooses the BUCKETS upper boundaries with the least
padding. Inside a bucket pieces are ordered by document and piece, and each batch takes as many as fit in TOKEN_BUDGET
when padded to the boundary. Places in a bucket are counted by range partitions: each counts its own rows, and the sums
of those before it are added, so that a bucket with a third of all rows needs no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .text_keys import SPACED, slices, words

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16384


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words) of each whole text: words between white space; null counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(words(data, offsets, SPACED).first) for _, _, data, offsets in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long")


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper boundaries of at most `buckets` buckets that minimise the padding of lengths counted in `histogram`.

    best[j] is the least padding of the j shortest lengths; each further bucket extends it by a last bucket from i to j.
    Among equal paddings the lower cut is taken, and fewer buckets if more do not help.
    """
    lengths = np.array(sorted(k for k in histogram if histogram[k] > 0), np.int64)
    if not len(lengths):
        return []
    number = np.concatenate([[0], np.cumsum([histogram[int(k)] for k in lengths])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([histogram[int(k)] * int(k) for k in lengths])]).astype(np.float64)
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            padding = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (total[j] - total[:j])
            cut[j] = int(padding.argmin())
            new[j] = padding[cut[j]]
        if cuts and new[n] >= best[n]:
            break
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bucket_len, batch, slot): where each piece of each document is packed.

    Batches are numbered from 0 inside a bucket, slots from 0 inside a batch. A boundary above the budget makes batches
    of one. Null, empty and blank texts have no piece. Rows with a null doc_id count too and come first; rows that repeat
    a doc_id each have their own pieces, ordered by length. Other columns are not read.
    """
    counts = saved(word_counts(docs).where("n_words > 0"))
    pieces = counts.select(
        "doc_id", F.col("n_words").alias("whole"),
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_words") / max_len).cast("int") - 1)).alias("piece"),
    ).select("doc_id", "whole", "piece", (F.col("piece").cast("long") * max_len).alias("first_word"), F.least(F.lit(max_len).cast("long"), F.col("whole") - F.col("piece").cast("long") * max_len).alias("n_words"))
    histogram = {r.n_words: r["count"] for r in pieces.groupBy("n_words").count().collect()}
    bounds = optimal_boundaries(histogram, buckets)
    bound = F.lit(max_len).cast("long")
    for b in reversed(bounds):
        bound = F.when(F.col("n_words") <= b, F.lit(b).cast("long")).otherwise(bound)
    order = ["bucket_len", "doc_id", "piece", "n_words", "whole"]
    own = Window.partitionBy("part", "bucket_len").orderBy(*order[1:])
    placed = saved(
        pieces.withColumn("bucket_len", bound).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    sums = placed.groupBy("bucket_len", "part").count()
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket_len", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return (
        placed.withColumn("rank", F.row_number().over(own) - 1).join(sums, ["bucket_len", "part"])
        .withColumn("place", F.col("before") + F.col("rank"))
        .select(
            "doc_id", "piece", "first_word", "n_words", "bucket_len",
            F.floor(F.col("place") / each).cast("long").alias("batch"), (F.col("place") % each).cast("int").alias("slot"),
        )
    )
