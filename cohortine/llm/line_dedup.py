"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of lower-cased words; the edit distance counts inserted, deleted and replaced words. An
occurrence of a line is dropped if an earlier one (by doc_id, then line number) is equal or, among lines of NEAR_WORDS
words or more, at distance 1. Lines without words are always kept.

Equal lines are collapsed first. Lines that have a neighbour share one half with it: with s words in the shorter of the
two, either its first s // 2 words or its other words stand at the same end of both. Lines without such a partner are
left out (exactly, the condition is necessary), the others emit their deletion neighbourhood as hashed keys: the line
less each word, the line with each word blanked, and the line itself. Two lines with an equal blanked variant differ in
one word at one place; a line equal to another less one word differs by that word. So within a key the earliest member
is a neighbour of all others and a minimum replaces all pairs, however large the group. Each line found is verified
against its earliest neighbour on the sequences of word hashes.

Bloom filters of bounded size keep keys that occur once out of the later shuffles; every decision is made by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import quoted, saved
from .text_keys import SPACED, Words, lines, mix, powers, raw_sequences, slices, words

#: Into so many parts the lines that share an earliest neighbour are dealt.
SALTS = 32
NEAR_WORDS = 8
_DELETED, _BLANKED = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _lined(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, line spans, first line of each document, first and last word of each line."""
    found = words(data, offsets, SPACED)
    starts, ends, first = lines(data, offsets)
    return found, starts, ends, first, np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)


def _keys(found: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(raw_sequences(found.hashes, a, b) + (b - a).astype(np.uint64))


def _occurrence(ids: np.ndarray, number: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A key of one line of one document."""
    return mix(mix(ids.view(np.uint64) + _DELETED) + number.astype(np.uint64) * _BLANKED) ^ key


def line_table(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, line, key, occ, n_words, halves) of every line with words; halves only of lines that may have neighbours."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in slices(batch.column(1)):
                found, _, _, first, a, b = _lined(data, offsets)
                count = np.diff(first)
                doc, number = np.repeat(ids[at:to], count), np.arange(first[-1]) - np.repeat(first[:-1], count)
                full = b > a
                doc, number, a, b = doc[full], number[full], a[full], b[full]
                key, m = _keys(found, a, b), b - a
                # As the shorter of two lines, or of equal length: s = m; as the longer: s = m - 1.
                low, high = (m - 1) // 2, m // 2
                halves = [
                    mix(raw_sequences(found.hashes, a, a + high) + _DELETED), mix(raw_sequences(found.hashes, a, a + low) + _DELETED),
                    mix(raw_sequences(found.hashes, b - (m - high), b) + _BLANKED), mix(raw_sequences(found.hashes, b - (m - 1 - low), b) + _BLANKED),
                ]
                one_less = m > near_words
                usable = [m >= near_words, one_less & (low != high), m >= near_words, one_less & (low == high)]
                usable = np.stack(usable, 1)
                bounds = np.concatenate([[0], np.cumsum(usable.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc), pa.array(number.astype(np.int32)), pa.array(key.view(np.int64)),
                        pa.array(_occurrence(doc, number, key).view(np.int64)), pa.array(m.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.stack(halves, 1)[usable].view(np.int64))),
                    ],
                    ["doc_id", "line", "key", "occ", "n_words", "halves"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, line int, key long, occ long, n_words int, halves array<long>")


def _variants(docs: DataFrame, occurrences: bytes, lines_held: bytes) -> DataFrame:
    """The deletion neighbourhood of each line whose occurrence the first filter passes: (key, doc_id, at_line, kind,
    variant, words).

    Kind W is the line itself (with its words), D the line less a word (if the second filter passes it as a line), B the
    line with a word blanked.
    """

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in slices(batch.column(1)):
                found, _, _, first, a, b = _lined(data, offsets)
                count = np.diff(first)
                doc, number = np.repeat(ids[at:to], count), np.arange(first[-1]) - np.repeat(first[:-1], count)
                key = _keys(found, a, b)
                keep = np.flatnonzero((b > a) & bloom.holds(occurrences, _occurrence(doc, number, key)))
                if not len(keep):
                    continue
                a, b, key, doc, number = a[keep], b[keep], key[keep], doc[keep], number[keep]
                m = b - a
                bounds = np.concatenate([[0], np.cumsum(m)])
                row = np.repeat(np.arange(len(m)), m)
                word = np.arange(bounds[-1]) - bounds[:-1][row] + a[row]
                forward, _ = powers(len(found.hashes) + 1)
                before, after = raw_sequences(found.hashes, a[row], word), raw_sequences(found.hashes, word + 1, b[row])
                place = (word - a[row]).astype(np.uint64)
                short = (m[row] - 1).astype(np.uint64)
                deleted = mix(before + after * forward[word - a[row]] + short)
                blanked = mix(mix(before + after * forward[word - a[row] + 1] + short) + place * _DELETED + _BLANKED)
                hit = np.flatnonzero(bloom.holds(lines_held, deleted))
                n, v = len(m), len(hit) + len(row)
                rows = np.concatenate([np.arange(n), row[hit], row])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[rows].view(np.int64)), pa.array(doc[rows]), pa.array(number[rows].astype(np.int32)),
                        pa.array(["W"] * n + ["D"] * len(hit) + ["B"] * len(row)),
                        pa.array(np.concatenate([key, deleted[hit], blanked]).view(np.int64)),
                        pa.concat_arrays(
                            [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.hashes.view(np.int64)[word])), pa.nulls(v, pa.list_(pa.int64()))]
                        ),
                    ],
                    ["key", "doc_id", "at_line", "kind", "variant", "words"],
                )

    return docs.select("doc_id", "text").mapInArrow(vary, "key long, doc_id long, at_line int, kind string, variant long, words array<long>")


def near_lines(docs: DataFrame, table: DataFrame, firsts: DataFrame) -> DataFrame:
    """Keys of the lines that have an earlier neighbour. firsts: (key, at, occ) of each distinct line of the table."""
    halves = table.select("key", F.explode("halves").alias("half"))
    shared = saved(halves.groupBy("half").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("half"))
    able = bloom.sift(halves, "half", bloom.fill(shared, "half")).join(shared, "half", "left_semi").select("key").distinct()
    able = saved(able.join(firsts, "key").select("key", "at", "occ"))
    variants = saved(_variants(docs, bloom.fill(able, "occ"), bloom.fill(able, "key")))
    member = F.struct(F.struct("doc_id", F.col("at_line").alias("line")).alias("at"), "key")
    blanked = variants.where("kind = 'B'").select("key", "doc_id", "at_line", "variant")
    twice = saved(blanked.groupBy("variant").count().where("count > 1").select("variant"))
    blanked = saved(bloom.sift(blanked, "variant", bloom.fill(twice, "variant")).join(twice, "variant", "left_semi").select("variant", "key", member.alias("m")))
    others = variants.where("kind <> 'B'").select("variant", "key", "kind", member.alias("m"))
    ends = others.groupBy("variant").agg(*(F.min(F.when(F.col("kind") == k, F.col("m"))).alias(k) for k in "WD"))
    found = (
        blanked.join(blanked.groupBy("variant").agg(F.min("m").alias("partner")), "variant").select("key", "m", "partner")
        .union(others.join(ends, "variant").select("key", "m", F.expr("CASE kind WHEN 'W' THEN D ELSE W END")))
        .where("partner.at < m.at AND partner.key <> key").join(able.select("key", "at"), "key").where("m.at = at")
    )
    # many lines may share one earliest neighbour: they are dealt by a salt, and its words go to every salt
    pairs = saved(
        found.groupBy("key").agg(F.min("partner").alias("partner"))
        .select("key", F.col("partner.key").alias("other"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    )
    texts = variants.where("kind = 'W'").select("key", "words").dropDuplicates(["key"])
    same_size = F.size(F.filter(F.zip_with("words", "owords", lambda x, y: x != y), lambda d: d)) == 1
    longer = F.when(F.size("words") > F.size("owords"), F.col("words")).otherwise(F.col("owords"))
    shorter = F.when(F.size("words") > F.size("owords"), F.col("owords")).otherwise(F.col("words"))
    one_less = F.exists(
        F.sequence(F.lit(0), F.size("shorter")),
        lambda i: (F.slice("longer", 1, i) == F.slice("shorter", 1, i))
        & (F.slice("longer", i + 2, F.size("longer")) == F.slice("shorter", i + 1, F.size("longer"))),
    )
    others = texts.join(pairs.select(F.col("other").alias("key")).distinct(), "key", "left_semi")
    others = others.select(F.col("key").alias("other"), F.col("words").alias("owords"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    checked = (
        pairs.join(texts, "key").join(others, ["other", "salt"])
        .withColumn("longer", longer).withColumn("shorter", shorter)
    )
    return checked.where(F.when(F.size("longer") == F.size("shorter"), same_size).otherwise((F.size("longer") == F.size("shorter") + 1) & one_less)).select("key")


def dropped_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, occ) of every occurrence to drop; see the module for the rule."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    table = saved(line_table(docs, near_words))
    firsts = saved(
        table.groupBy("key").agg(F.min(F.struct("doc_id", "line", "occ")).alias("f"), F.count("*").alias("n"))
        .select("key", F.struct("f.doc_id", "f.line").alias("at"), F.col("f.occ").alias("occ"), "n")
    )
    near = saved(near_lines(docs, table, firsts).distinct())
    several = firsts.where("n > 1").select("key", F.col("occ").alias("kept")).join(near, "key", "left_anti")
    doomed = several.union(near.select("key", F.lit(None).cast("long")))
    return table.select("doc_id", "key", "occ").join(doomed, "key").where("kept IS NULL OR kept <> occ").select("doc_id", "occ").distinct()


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with `text` less the dropped lines; all other columns, whatever their names, stay as they are.

    Null texts stay null; rows with a null doc_id are neither changed nor held against others. Rows that repeat a doc_id
    with the same text keep the same lines. A text may become empty.
    """
    drops = saved(dropped_lines(docs, near_words)).groupBy("doc_id").agg(F.collect_list("occ").alias("drops"))
    others = F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text"), F.lit(0).alias("`")).alias("row")
    joined = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("old"), others).join(
        drops.withColumnRenamed("doc_id", "gone"), F.col("id") == F.col("gone"), "left"
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            out = batch.column(1).to_pylist()
            drops = batch.column(2)
            for i in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)).tolist():
                data = np.frombuffer(out[i].encode(), np.uint8)
                found, starts, ends, _, a, b = _lined(data, np.array([0, len(data)]))
                ids = np.full(len(a), batch.column(0)[i].as_py())
                occ = _occurrence(ids, np.arange(len(a)), _keys(found, a, b))
                kept = (a == b) | ~np.isin(occ, drops[i].values.to_numpy().view(np.uint64))
                whole = data.tobytes()
                out[i] = b"\n".join(whole[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())).decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(3)], ["text", "row"])

    schema = joined.select(F.col("old").alias("text"), "row").schema
    fixed = joined.select("id", "old", "drops", "row").mapInArrow(rebuild, schema)
    return fixed.select(*(F.col("text") if c == "text" else F.col("row." + quoted(c)) for c in docs.columns))
