"""Language identification by prediction by partial matching with frozen statistics.

For every language a byte context tree of depth ORDER is counted on a bounded sample of labelled documents. Coding a
symbol in a context of length d costs -log2 of its share there; a symbol never seen there costs the escape of that
context and is coded in the context one shorter, down to a uniform code. Escapes follow method C: in a context with n
symbols of which m differ, a seen symbol has probability count / (n + m) and the escape m / (n + m). The statistics are
frozen, so the length of a whole text is a sum of table entries and is the same wherever a text is scored.

Bytes: ASCII letters are lower-cased; the SYMBOLS - 1 most frequent byte values of the sample are symbols, all others
share the last one (what tells them apart costs the same in all languages). Before its first byte a text has spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import quoted
from .text_keys import LOWER, slices

ORDER = 3
SYMBOLS = 64
#: Expected number of documents in the training sample of each language: its bound.
TRAIN_DOCS = 400
UNDETERMINED = "und"


class Model(NamedTuple):
    """Code lengths in bits. Symbols of contexts are digits in base SYMBOLS, the latest one lowest."""

    langs: list[str]
    symbol: np.ndarray  # of each byte value
    seen: np.ndarray  # sorted keys (context of ORDER symbols, symbol) counted in any language
    cost: np.ndarray  # of each of these keys, by language
    escape: np.ndarray  # of each context of ORDER symbols, by language
    shorter: np.ndarray  # of each (context of ORDER - 1 symbols, symbol), by language


def training_sample(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of about `docs_per_lang` rows of each language, chosen by the hash of doc_id."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(docs_per_lang)) / F.col("count"))
    return rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")


def _grams(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the key of its ORDER predecessors and itself; the offset of each document among them."""
    lengths = np.diff(offsets)
    padded = np.full(len(data) + ORDER * len(lengths), symbol[32], np.int32)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = symbol[LOWER[data]]
    whole = padded[: len(padded) - ORDER].copy() if len(padded) > ORDER else np.zeros(0, np.int32)
    for j in range(1, ORDER + 1):
        whole *= SYMBOLS
        whole += padded[j : len(padded) - ORDER + j]
    return whole[at - ORDER], offsets


def _counts(sample: DataFrame, symbol: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted (context, symbol) keys of full depth and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for at, to, data, offsets in slices(batch.column(1)):
                keys, _ = _grams(data, offsets, symbol)
                own = np.repeat(langs[at:to], np.diff(offsets))
                for lang in np.unique(own):
                    key, n = np.unique(keys[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "key", "n"])

    table = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).orderBy("lang", "key").toArrow()
    langs, keys, n = table["lang"].to_pandas(), table["key"].to_numpy(), table["n"].to_numpy()
    return {lang: (keys[langs == lang], n[langs == lang]) for lang in sorted(langs.unique())}


def _code(keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of the `seen` keys, escapes of the contexts of full depth and costs one context shorter, in one language."""
    below = np.full((1, SYMBOLS), np.log2(SYMBOLS))
    for depth in range(ORDER):
        at = np.bincount(keys % SYMBOLS ** (depth + 1), weights=n, minlength=SYMBOLS ** (depth + 1)).reshape(-1, SYMBOLS)
        total, kinds = at.sum(axis=1), (at > 0).sum(axis=1)
        leave = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        own = -np.log2(np.maximum(at, 1) / np.maximum(total + kinds, 1)[:, None])
        below = np.where(at > 0, own, leave[:, None] + np.tile(below, (len(at) // len(below), 1)))
    total = np.bincount(keys // SYMBOLS, weights=n, minlength=SYMBOLS**ORDER)
    kinds = np.bincount(keys // SYMBOLS, minlength=SYMBOLS**ORDER)
    leave = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
    shorter, context = below.reshape(-1), seen // SYMBOLS
    cost = leave[context] + shorter[seen % SYMBOLS**ORDER]
    place = np.searchsorted(seen, keys)
    cost[place] = -np.log2(n / (total + kinds)[keys // SYMBOLS])
    return tuple(x.astype(np.float32) for x in (cost, leave, shorter))


def fit(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> Model:
    """Count the context trees of every language among the labelled rows and freeze their code lengths.

    Reads doc_id (to draw the sample), text and lang; rows where one is null teach nothing. Only counts of the bounded
    sample reach the driver.
    """
    sample = training_sample(labelled.select("doc_id", "text", "lang"), docs_per_lang).persist()
    frequent = np.zeros(256, np.int64)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, _ in slices(batch.column(0)):
                n = np.bincount(LOWER[data], minlength=256)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["byte", "n"])

    for row in sample.select("text").mapInArrow(bytes_of, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        frequent[row.byte] = row.n
    symbol = np.full(256, SYMBOLS - 1, np.int32)
    frequent[32] += 1
    top = np.argsort(-frequent, kind="stable")[: SYMBOLS - 1]
    symbol[top[frequent[top] > 0]] = np.arange((frequent[top] > 0).sum())
    trees = _counts(sample, symbol)
    sample.unpersist()
    if not trees:
        none = np.zeros((0, 0), np.float32)
        return Model([], symbol, np.zeros(0, np.int64), none, none, none)
    seen = np.unique(np.concatenate([keys for keys, _ in trees.values()]))
    cost, escape, shorter = zip(*(_code(keys, n, seen) for keys, n in trees.values()))
    return Model(list(trees), symbol, seen, np.stack(cost, 1), np.stack(escape, 1), np.stack(shorter, 1))


class Index(NamedTuple):
    """Where the keys of a context of full depth stand among `seen`: the first place, and a bit for each symbol seen."""

    first: np.ndarray
    symbols: np.ndarray


def key_index(model: Model) -> Index:
    context = model.seen // SYMBOLS
    bit = np.uint64(1) << (model.seen % SYMBOLS).astype(np.uint64)
    symbols = np.zeros(SYMBOLS**ORDER, np.uint64)
    np.bitwise_or.at(symbols, context, bit)
    return Index(np.searchsorted(context, np.arange(SYMBOLS**ORDER)).astype(np.int32), symbols)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, index: Index) -> np.ndarray:
    """Bits of each document under each language."""
    keys, _ = _grams(data, offsets, model.symbol)
    context, bit = keys // SYMBOLS, np.uint64(1) << (keys % SYMBOLS).astype(np.uint64)
    symbols = index.symbols[context]
    place = index.first[context] + np.bitwise_count(symbols & (bit - np.uint64(1)))
    new = np.flatnonzero(symbols & bit == 0)
    place[new] = 0
    bits = model.cost[place]
    bits[new] = model.escape[context[new]] + model.shorter[keys[new] % SYMBOLS**ORDER]
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
    return out


def _scores(model: Model, index: Index, texts: pa.Array, lettered: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior and bits a byte of each text."""
    best, sure, rate = [], [], []
    for _, _, data, offsets in slices(texts):
        bits = code_lengths(model, data, offsets, index)
        least = bits.min(axis=1)
        best.append(bits.argmin(axis=1))
        sure.append(1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1))
        rate.append(least / np.maximum(np.diff(offsets), 1))
    best, sure, rate = (np.concatenate(x) if x else np.zeros(0) for x in (best, sure, rate))
    lettered = lettered.fill_null(False).to_numpy(zero_copy_only=False)
    names = np.array([*model.langs, UNDETERMINED])
    return names[np.where(lettered, best, len(model.langs)).astype(np.int64)], np.where(lettered, sure, 0.0), np.where(lettered, rate, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of the whole text of every row; other columns are not read.

    The language with the shortest code wins, ties go to the first in alphabetical order; score is its posterior
    probability under equal priors. A null text, one without a letter, or a model without languages gives `und` with
    score 0. Every row gives a row, repeated ones and those with a null doc_id too.
    """
    rows = docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    if not model.langs:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = key_index(held.value)
        for batch in batches:
            found = _scores(held.value, index, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs, whole and without a shuffle, whose language is determined with a score above `least_score`."""
    if not model.langs:
        return docs.where("false")
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text"), F.lit(0).alias("`")).alias("row")
    rows = docs.select("text", F.col("text").rlike(r"\p{L}").alias("lettered"), others)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = key_index(held.value)
        for batch in batches:
            lang, sure, _ = _scores(held.value, index, batch.column(0), batch.column(1))
            yield batch.select([0, 2]).filter(pa.array((lang != UNDETERMINED) & (sure > least_score)))

    kept = rows.mapInArrow(sift, rows.select("text", "row").schema)
    return kept.select(*(F.col("text") if c == "text" else F.col("row." + quoted(c)) for c in docs.columns))
