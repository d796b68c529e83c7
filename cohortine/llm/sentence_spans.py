"""Substring deduplication by sliding spans of consecutive sentences.

A sentence ends at a word with a final full stop, question or exclamation mark, or at a line feed; it is its sequence of
lower-cased words. From each sentence starts one run: the shortest of at least SENTENCES sentences and LEAST_WORDS
words. A run is repeated if an equal one starts elsewhere; the first (by doc_id, then place) stays, and sentences covered
by any other go.

Counting the runs of all documents moves one hash a sentence. A Bloom filter of bounded size of the repeated ones then
lets a second reading emit, with their places, only runs that may be repeated; a join decides exactly.

With `longest`, sentences of more words are parted further, before each word whose hash is the least of CUT consecutive
ones. Such cuts depend on the CUT - 1 words on either side only and stand CUT words apart at most, so equal passages are
cut alike whatever stands around them: with the query's values, passages of 50 words or more always share a run. A part
then counts as a sentence everywhere, and a stop followed by a closing quote or bracket ends one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .scratch import quoted, saved
from .text_keys import SPACED, Words, mix, raw_sequences, slices, words

SENTENCES = 2
LEAST_WORDS = 16
#: Words of a sentence that the query leaves whole; words between cuts of longer ones.
LONGEST = 15
CUT = 8
_FINAL = np.zeros(256, bool)
_FINAL[[33, 46, 63]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[34, 39, 41, 93, 125]] = True


def _cuts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words have the least hash (the last of equal ones) of some CUT consecutive words of their document."""
    out, n = np.zeros(len(hashes), bool), max(0, len(hashes) - CUT + 1)
    at = np.arange(n)
    for j in range(1, CUT):
        at = np.where(hashes[j : j + n] <= hashes[at], np.arange(j, j + n), at)
    whole = np.arange(n) + CUT <= np.repeat(first[1:], np.diff(first))[:n]
    out[at[whole]] = True
    return out


def sentence_bounds(data: np.ndarray, offsets: np.ndarray, longest: int | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, first word of each sentence (and the number of words), first sentence of each document."""
    found = words(data, offsets, SPACED)
    if not len(found.starts):
        return found, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    feeds = np.flatnonzero(data == 10)
    opens = np.ones(len(found.starts), bool)
    feed = np.searchsorted(feeds, found.starts)
    last = found.ends[:-1] - 1
    opens[1:] = _FINAL[data[last]] | (feed[1:] > feed[:-1])
    if longest:
        opens[1:] |= _CLOSING[data[last]] & _FINAL[data[last - 1]] & (last > found.starts[:-1])
    opens[found.first[:-1][found.first[:-1] < len(opens)]] = True
    if longest:
        size = np.diff(np.append(np.flatnonzero(opens), len(opens)))
        opens |= np.repeat(size > longest, size) & _cuts(found.hashes, found.first)
    bounds = np.append(np.flatnonzero(opens), len(opens))
    return found, bounds, np.searchsorted(bounds, found.first)


def _runs(data: np.ndarray, offsets: np.ndarray, sentences: int, least: int, longest: int | None = None) -> tuple[np.ndarray, ...]:
    """Hash, document (in the slice), first sentence, sentence after, words of each run; sentences count from 0."""
    found, bounds, first = sentence_bounds(data, offsets, longest)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.arange(n)
    to = np.maximum(at + sentences, np.searchsorted(bounds, bounds[:-1] + least))
    full = to <= first[1:][doc] if n else np.zeros(0, bool)
    at, to, doc = at[full], to[full], doc[full]
    size = bounds[to] - bounds[at]
    return mix(raw_sequences(found.hashes, bounds[at], bounds[to]) + size.astype(np.uint64)), doc, at - first[doc], to - first[doc], size


def repeated_runs(docs: DataFrame, sentences: int = SENTENCES, least: int = LEAST_WORDS, longest: int | None = None) -> DataFrame:
    """(doc_id, first, after, n_words, keeper): each run of sentences that is not the first of its kind, with the
    document that keeps the first; several times if several rows of the document have it."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_runs(data, offsets, sentences, least, longest)[0].view(np.int64))], ["run"])

    several = docs.select("text").mapInArrow(hashes, "run long").groupBy("run").count().where("count > 1").select("run")
    bitmap = bloom.fill(saved(several), "run", 25)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in slices(batch.column(1)):
                run, doc, first, after, size = _runs(data, offsets, sentences, least, longest)
                hit = bloom.holds(bitmap, run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run[hit].view(np.int64)), pa.array(ids[at + doc[hit]]), *(pa.array(x[hit]) for x in (first, after, size))],
                    ["run", "doc_id", "first", "after", "n_words"],
                )

    table = saved(docs.mapInArrow(places, "run long, doc_id long, first long, after long, n_words long"))
    firsts = saved(
        table.groupBy("run").agg(F.min(F.struct("doc_id", "first")).alias("keep"), F.count("*").alias("m")).where("m > 1")
        .select("run", F.col("keep.doc_id").alias("keeper"), F.col("keep.first").alias("kept"))
    )
    return table.join(firsts, "run").where("doc_id <> keeper OR first <> kept").select("doc_id", "first", "after", "n_words", "keeper")


def duplicate_spans(docs: DataFrame, sentences: int = SENTENCES, least: int = LEAST_WORDS, longest: int | None = None) -> DataFrame:
    """(doc_id, first_sentence, last_sentence, first_doc_id) of each maximal span of sentences to remove.

    first_doc_id is the smallest of the documents that keep a first copy of a run in the span. Null, empty and short
    texts have no runs. Rows with a null doc_id take no part; rows that repeat a doc_id with the same text are one
    document, with other texts their runs add up. Other columns are not read. A document's own runs meet in one group,
    bounded by its length.
    """
    along = Window.partitionBy("doc_id").orderBy("first", "after")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # dealt by document once, for the groups and the windows
    runs = repeated_runs(docs, sentences, least, longest).select("doc_id", "first", "after", "keeper").repartition("doc_id").groupBy("doc_id", "first").agg(F.max("after").alias("after"), F.min("keeper").alias("keeper"))
    return (
        runs.withColumn("new", F.coalesce((F.col("first") > F.max("after").over(before)).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("new").over(along))
        .groupBy("doc_id", "span").agg(F.min("first").alias("first_sentence"), (F.max("after") - 1).alias("last_sentence"), F.min("keeper").alias("first_doc_id"))
        .drop("span")
    )


def remove_spans(docs: DataFrame, spans: DataFrame, longest: int | None = None) -> DataFrame:
    """docs with `text` less the given spans of sentences; what stands between words of kept sentences stays.

    `longest` must be that of the spans. Other columns pass through whatever their names; null texts and documents without spans stay as they are.
    """
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first_sentence", "last_sentence")).alias("spans")).withColumnRenamed("doc_id", "gone")
    others = F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text"), F.lit(0).alias("`")).alias("row")
    joined = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("old"), others).join(gone, F.col("id") == F.col("gone"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(0).to_pylist()
            for i, own in enumerate(batch.column(1).to_pylist()):
                if own and out[i] is not None:
                    data = np.frombuffer(out[i].encode(), np.uint8)
                    found, bounds, _ = sentence_bounds(data, np.array([0, len(data)]), longest)
                    keep = np.ones(len(data), bool)
                    for s in own:
                        a, b = s["first_sentence"], min(s["last_sentence"] + 1, len(bounds) - 1)
                        if a < b:
                            keep[found.starts[bounds[a]] : found.starts[bounds[b]] if bounds[b] < len(found.starts) else len(data)] = False
                    out[i] = data[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["text", "row"])

    fixed = joined.select("old", "spans", "row").mapInArrow(cut, joined.select(F.col("old").alias("text"), "row").schema)
    return fixed.select(*(F.col("text") if c == "text" else F.col("row." + quoted(c)) for c in docs.columns))


def span_report(docs: DataFrame) -> DataFrame:
    """`duplicate_spans` with sentences parted at LONGEST words, and the digest of each document's text without its spans
    (several, sorted, where rows with other texts repeat a doc_id)."""
    spans = saved(duplicate_spans(docs, longest=LONGEST))
    touched = bloom.sift(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), "doc_id", bloom.fill(spans, "doc_id"))
    after = remove_spans(touched, spans, LONGEST).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(F.sha2("text", 256))), ",").alias("text_sha256"))
    return spans.join(after, "doc_id")
