"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). Seen as a set of shingles, a
window is contained in a document region only if all its shingles are, so one necessary token suffices as its prefix:
its rarest shingle, by the count of that shingle in all documents. Documents emit just the places of such tokens,
a join finds the windows, the token's position fixes where the window would have to lie (positional bound) and the
document must hold that many words there (length bound); then all words of the window are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .scratch import saved
from .text_keys import ALNUM, gram_hashes, slices, words

WINDOW = 10
SHINGLE = 3


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window words as hashes, shingle hash, offset of the shingle, words of a shingle)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for at, to, data, offsets in slices(batch.column(1)):
                found = words(data, offsets, ALNUM)
                for i in range(to - at):
                    h = found.hashes[found.first[i] : found.first[i + 1]]
                    size = min(window, len(h))
                    for j in range(len(h) - size + 1 if size else 0):
                        own = h[j : j + size]
                        k = min(shingle, size)
                        value = own.view(np.int64).tolist()
                        rows += [(ids[at + i], value, s, o, k) for o, s in enumerate(gram_hashes(own, k).view(np.int64).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()))],
                    ["item_id", "words", "token", "at", "k"],
                )

    return items.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(
        cut, "item_id string, words array<long>, token long, at int, k int"
    )


def _token_counts(docs: DataFrame, bitmap: bytes, sizes: list[int]) -> DataFrame:
    """How often each shingle that the filter passes occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = words(data, offsets, ALNUM)
                ends = np.repeat(found.first[1:], np.diff(found.first))
                grams = np.concatenate([g[np.arange(k, k + len(g)) <= ends[: len(g)]] for k in sizes for g in [gram_hashes(found.hashes, k)]])
                token, times = np.unique(grams[bloom.holds(bitmap, grams)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], ["token", "times"])

    return docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))


def _places(docs: DataFrame, bitmap: bytes, sizes: list[int], reach: int) -> DataFrame:
    """A row of each document (token null, its number of words), and one of each place of a token that the filter
    passes, with the `reach` word hashes on both sides; where the document ends, the list is short."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in slices(batch.column(1)):
                found = words(data, offsets, ALNUM)
                ends = np.repeat(found.first[1:], np.diff(found.first))
                starts = np.repeat(found.first[:-1], np.diff(found.first))
                doc = np.repeat(np.arange(at, to), np.diff(found.first))
                token, place, size = [], [], []
                for k in sizes:
                    grams = gram_hashes(found.hashes, k)
                    hit = np.flatnonzero(bloom.holds(bitmap, grams))
                    hit = hit[hit + k <= ends[hit]]
                    token.append(grams[hit])
                    place.append(hit)
                    size.append(np.full(len(hit), k))
                token, place, size = (np.concatenate(x) for x in (token, place, size))
                low, high = np.maximum(place - reach, starts[place]), np.minimum(place + reach, ends[place])
                wide = high - low
                bounds = np.concatenate([[0], np.cumsum(wide)])
                flat = np.repeat(low - bounds[:-1], wide) + np.arange(bounds[-1])
                n = to - at
                blank = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[at:to], ids[doc[place]]])),
                        pa.array(np.concatenate([np.diff(found.first), np.zeros(len(place), np.int64)])),
                        pa.concat_arrays([blank, pa.array(token.view(np.int64))]),
                        pa.concat_arrays([blank.cast(pa.int32()), pa.array(size.astype(np.int32))]),
                        pa.concat_arrays([blank, pa.array((place - starts[place]).astype(np.int64))]),
                        pa.concat_arrays([blank.cast(pa.int32()), pa.array((place - low).astype(np.int32))]),
                        pa.concat_arrays(
                            [
                                pa.nulls(n, pa.list_(pa.int64())),
                                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.hashes.view(np.int64)[flat])),
                            ]
                        ),
                    ],
                    ["doc_id", "n_words", "token", "k", "place", "before", "near"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        find, "doc_id long, n_words long, token long, k int, place long, before int, near array<long>"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n_words), and each occurrence of a window in one: (doc_id, start, size, item_id).

    Null or wordless texts have no words; wordless items no window. Repeated rows of a doc_id count as one document
    with the words of the longest; rows with a null doc_id take no part. Other columns are not read. The benchmark is
    joined, not broadcast; what is broadcast are two Bloom filters of 1 MB.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    grams = saved(item_windows(items.select("item_id", "text"), window, shingle))
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # at most `shingle` values
    if not sizes:
        places = saved(_places(docs, bytes(1 << 17), [shingle], window))
        return places.groupBy("doc_id").agg(F.max("n_words").alias("n_words")), places.select("doc_id", F.col("place").alias("start"), F.col("k").alias("size"), F.lit("").alias("item_id")).where("false")
    counts = _token_counts(docs, bloom.fill(grams, "token"), sizes)
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "token", "k"))
    prefix = saved(
        grams.drop("item_id").distinct().join(counts, "token", "left").groupBy("words").agg(rarest.alias("p"))
        .select("words", "p.token", "p.at", "p.k")
    )
    places = saved(_places(docs, bloom.fill(prefix, "token"), sizes, window))
    found = (
        places.where("token IS NOT NULL").join(prefix, ["token", "k"])
        .where("at <= before AND before - at + size(words) <= size(near)")
        .where("slice(near, before - at + 1, size(words)) = words")
        .select("doc_id", (F.col("place") - F.col("at")).alias("start"), F.size("words").alias("size"), "words")
        .distinct()
    )
    hits = found.join(grams.select("item_id", "words").distinct(), "words").select("doc_id", "start", "size", "item_id")
    return places.where("token IS NULL").groupBy("doc_id").agg(F.max("n_words").alias("n_words")), hits


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: words, words inside any occurrence of a window, items with occurring windows and their digest.

    A document without hits has n_hit 0, n_items 0 and the digest of the empty string; see `contamination` for nulls
    and repeated rows. A document may hold as many hits as words, in any number of tasks up to here; its own hits meet
    in one group, whose size its length bounds.
    """
    words_of, hits = contamination(docs, items, window, shingle)
    hits = saved(hits)
    reach = hits.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        reach.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("n_hit"))
    )
    named = hits.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    return words_of.join(covered, "doc_id", "left").join(named, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
