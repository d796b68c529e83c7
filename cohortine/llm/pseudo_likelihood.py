"""Language-model scoring by masked pseudo-likelihood.

A token is a lower-cased word. The VOCABULARY most frequent words of all documents have ids, all others share one in
the network, whatever their number, but each is scored with its own share of the others' counts, by a join; ids are dealt in order of frequency into CLASSES classes of about equal mass. A small network sees the SIDE tokens on each
side of a masked one (one embedding table per place, tanh, softmax) and predicts the class of the masked token; inside
its class a word has its share of the corpus counts. A document's score is the sum of the log-probabilities of all its
tokens, each given both its sides.

Counts are taken over all documents and kept in a table. Every token of every document is a training window, ROUNDS times.
Texts become pieces of word ids, two bytes a token; pieces are dealt into shards of about SHARD windows by a hash of their
document, so neither batches nor partitions change them. Each shard trains from the common weights, and the weights are
averaged over a tree of sums with bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .text_keys import ALNUM, Words, mix, raw_sequences, slices, words

VOCABULARY = 4094
CLASSES = 128
WIDTH = 16
SIDE = 2
#: About so many windows are a shard; windows of a step; rounds of averaging; tokens of a piece.
SHARD = 1 << 20
BATCH = 4096
ROUNDS = 1
PIECE = 16_384
_FAN_IN = 64
#: Windows that are scored at once, few enough for a processor's cache.
SCORED = 2048
#: Log-shares are summed over words as integers of this fineness, so that the order of rows does not count.
_FINE = 1 << 30
#: Tokens counted at once in a task before the counts are passed on.
_COUNTED = 2_000_000
#: Exponentials of numbers below this, and their sums over the classes, are far from the ends of single precision.
_SAFE = 60.0


class Vocabulary(NamedTuple):
    """Sorted hashes of the known words with their ids (1 and up; 0 is any other word, the last one the text's edge)."""

    hashes: np.ndarray
    ids: np.ndarray
    classes: np.ndarray  # of each id
    log_share: np.ndarray  # of each id inside its class; 0 for id 0, whose words have theirs in a table


class Network(NamedTuple):
    """embed[p, id] for each place of the window, then the output layer."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, times) over all documents; a saved table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                held.append(words(data, offsets, ALNUM).hashes)
                n += len(held[-1])
                if n >= _COUNTED:
                    yield totals(held)
                    held, n = [], 0
        if held:
            yield totals(held)

    def totals(held: list[np.ndarray]) -> pa.RecordBatch:
        word, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(times)], ["word", "times"])

    return saved(docs.select("text").mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """Word counts over all documents; VOCABULARY of them and two totals reach the driver."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("times"), "word").limit(VOCABULARY).toPandas()
    whole = counts.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("times")).first()
    times = np.concatenate([[whole.times - top["times"].sum()], top["times"], [0]]).astype(np.float64)
    classes = np.zeros(len(times), np.int64)
    known = times[1:-1]
    if len(known):
        reach = np.cumsum(known) - known / 2
        classes[1:-1] = 1 + np.minimum((reach / known.sum() * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
    mass = np.bincount(classes, weights=times, minlength=CLASSES)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(times > 0, np.log(times / mass[classes]), 0.0)
    share[0] = 0.0
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64)[order], order + 1, classes, share)


def _ids(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """Ids of each token, and the words."""
    found = words(data, offsets, ALNUM)
    ids = np.zeros(len(found.hashes), np.int32)
    if len(vocab.hashes):
        near = np.minimum(np.searchsorted(vocab.hashes, found.hashes), len(vocab.hashes) - 1)
        known = vocab.hashes[near] == found.hashes
        ids[known] = vocab.ids[near[known]]
    return ids, found


def _unrolled(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows without their middle, and the middles, of pieces of ids with margins."""
    around, target = [np.zeros((0, 2 * SIDE), np.int16)], [np.zeros(0, np.int16)]
    for piece in pieces:
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(piece, np.int16), 2 * SIDE + 1)
        around.append(np.delete(windows, SIDE, axis=1))
        target.append(windows[:, SIDE])
    return np.concatenate(around), np.concatenate(target)


def _windows(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Ids of each token, ids of its window (left to right, without itself), the words."""
    ids, found = _ids(vocab, data, offsets)
    n, edge = len(ids), len(vocab.classes) - 1
    starts, ends = np.repeat(found.first[:-1], np.diff(found.first)), np.repeat(found.first[1:], np.diff(found.first))
    around = np.full((n, 2 * SIDE), edge, np.int32)
    for column, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = np.arange(n) + step
        inside = (at >= starts) & (at < ends)
        around[inside, column] = ids[at[inside]]
    return ids, around, found


def _exponentials(logits: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """The logits' exponentials in their place, less the row's maximum where the layer could let them leave the numbers' range;
    inputs lie within -1 and 1. Returns what was subtracted."""
    least = np.zeros((1, 1), logits.dtype)
    if not np.abs(layer).sum(axis=0).max() < _SAFE:
        least = logits.max(axis=1, keepdims=True)
        logits -= least
    np.exp(logits, out=logits)
    return least


class _Room(NamedTuple):
    """Arrays that hold the values of some windows at a time; fresh ones cost more than what is done with them."""

    part: np.ndarray
    total: np.ndarray
    hidden: np.ndarray  # its last column stays 1, for the bias
    logits: np.ndarray

    @classmethod
    def of(cls, embed: np.ndarray, layer: np.ndarray, most: int) -> _Room:
        wide = embed.shape[2]
        part, total = (np.empty((most, wide), embed.dtype) for _ in range(2))
        return cls(part, total, np.ones((most, wide + 1), layer.dtype), np.empty((most, layer.shape[1]), layer.dtype))

    def first(self, n: int) -> _Room:
        return _Room(*(x[:n] for x in self))


def _logits(embed: np.ndarray, layer: np.ndarray, around: np.ndarray, room: _Room) -> None:
    """The hidden values and the logits of each window, into the room."""
    np.take(embed[0], around[:, 0], axis=0, out=room.total, mode="clip")
    for p in range(1, around.shape[1]):
        np.add(room.total, np.take(embed[p], around[:, p], axis=0, out=room.part, mode="clip"), out=room.total)
    np.tanh(room.total, out=room.hidden[:, :-1])
    np.matmul(room.hidden, layer, out=room.logits)


def _log_of(net: Network, around: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log-probability of the wanted class of each window."""
    layer = np.vstack([net.out, net.bias])
    out, each, whole = np.empty(len(around), layer.dtype), np.ones(layer.shape[1], layer.dtype), _Room.of(net.embed, layer, SCORED)
    for low in range(0, len(around), SCORED):
        part = slice(low, low + SCORED)
        room = whole.first(len(around[part]))
        _logits(net.embed, layer, around[part], room)
        own = room.logits[np.arange(len(room.logits)), wanted[part]]
        own -= _exponentials(room.logits, layer)[:, 0]
        out[part] = own - np.log(room.logits @ each)
    return out


def _train(net: Network, around: np.ndarray, target: np.ndarray, seed: int, rate: float) -> Network:
    """One pass of Adagrad on the cross-entropy of the masked token's class, in small batches of a random order."""
    embed, layer = np.array(net.embed, np.float32), np.vstack([net.out, net.bias]).astype(np.float32)
    scale = [np.full(x.shape, 1e-2, np.float32) for x in (embed, layer)]
    each, whole = np.ones(layer.shape[1], np.float32), _Room.of(embed, layer, BATCH)
    order = np.random.default_rng(seed).permutation(len(target))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        near, room = around.take(rows, axis=0), whole.first(len(rows))
        _logits(embed, layer, near, room)
        wrong, hidden, back = room.logits, room.hidden, room.total
        _exponentials(wrong, layer)
        wrong *= (1 / (wrong @ each * np.float32(len(rows))))[:, None]
        wrong[np.arange(len(rows)), target[rows]] -= np.float32(1 / len(rows))
        slope = hidden.T @ wrong
        np.matmul(wrong, layer[:-1].T, out=back)
        np.square(hidden[:, :-1], out=room.part)
        np.multiply(back, np.subtract(1, room.part, out=room.part), out=back)
        scale[1] += slope**2
        layer -= rate * slope / np.sqrt(scale[1])
        for p in range(near.shape[1]):
            by = np.argsort(near[:, p], kind="stable")
            own = near[by, p]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            used, slope = own[first], np.add.reduceat(np.take(back, by, axis=0, out=room.part, mode="clip"), first, axis=0)
            grown = scale[0][p].take(used, axis=0) + slope**2
            scale[0][p, used] = grown
            embed[p, used] -= rate * slope / np.sqrt(grown)
    return Network(embed, layer[:-1], layer[-1])


def _pack(net: Network) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net]).astype(np.float32)


def _unpack(flat: np.ndarray, ids: int) -> Network:
    sizes = [(2 * SIDE, ids, WIDTH), (WIDTH, CLASSES), (CLASSES,)]
    cuts = np.cumsum([int(np.prod(s)) for s in sizes])
    return Network(*(x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat[: cuts[-1]], cuts[:-1]), sizes)))


def fit(docs: DataFrame, vocab: Vocabulary, rate: float = 0.1) -> Network:
    """Train on the windows of all tokens of all documents. Without any token the weights stay as they begin."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocab)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at, to, data, offsets in slices(batch.column(1)):
                ids, found = _ids(known.value, data, offsets)
                first = found.first
                seeds = mix(mix(keys[at:to].copy()) + raw_sequences(found.hashes, first[:-1], first[1:]))
                place, pieces, n = [], [], []
                margin = np.full(SIDE, len(known.value.classes) - 1, np.int16)
                for seed, low, high in zip(seeds, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    whole = np.concatenate([margin, ids[low:high].astype(np.int16), margin])
                    for number, start in enumerate(range(0, high - low, PIECE)):
                        part = whole[start : start + PIECE + 2 * SIDE]
                        place.append(seed + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15))
                        pieces.append(part.tobytes())
                        n.append(len(part) - 2 * SIDE)
                if place:
                    yield pa.RecordBatch.from_arrays([pa.array(mix(np.array(place, np.uint64)).view(np.int64)), pa.array(n, pa.int64()), pa.array(pieces, pa.binary())], ["place", "n", "ids"])

    pieces = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "place long, n long, ids binary"))
    shards = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // SHARD))
    random = np.random.default_rng(1)
    ids = len(vocab.classes)
    flat = _pack(Network(random.normal(0, 0.1, (2 * SIDE, ids, WIDTH)), random.normal(0, 0.1, (WIDTH, CLASSES)), np.zeros(CLASSES)))
    dealt = pieces.select(F.pmod("place", F.lit(shards)).alias("shard"), "ids")
    for step in range(ROUNDS):
        common = spark.sparkContext.broadcast(flat)

        def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            around, target = _unrolled(sorted(rows["ids"]))
            net = _train(_unpack(common.value, ids), around, known.value.classes[target], int(key[0]), rate)  # noqa: B023
            return pd.DataFrame({"shard": [key[0]], "n": [float(len(target))], "weights": [(_pack(net) * len(target)).tobytes()]})

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            total = sum(np.frombuffer(w, np.float32).astype(np.float64) for w in rows["weights"])
            return pd.DataFrame({"shard": [key[0]], "n": [rows["n"].sum()], "weights": [total.astype(np.float32).tobytes()]})

        sums = saved(dealt.groupBy("shard").applyInPandas(train, "shard long, n double, weights binary"))
        left = shards
        while left > 1:
            left = -(-left // _FAN_IN)
            sums = saved(sums.withColumnRenamed("shard", "part").groupBy((F.col("part") / _FAN_IN).cast("long").alias("shard")).applyInPandas(add, "shard long, n double, weights binary"))
        last = sums.first()
        if last is not None and last.n:
            flat = (np.frombuffer(last.weights, np.float32) / last.n).astype(np.float32)
    return _unpack(flat, ids)


def score(docs: DataFrame, vocab: Vocabulary, net: Network, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of the whole text of every row; natural logarithms.

    Null, empty and wordless texts have no words, sum 0 and no mean. Every row gives a row, repeated ones and those with
    a null doc_id too. Other columns are not read. `counts` are those of the vocabulary, by default of docs; a word that
    they lack counts as seen once.
    """
    counts = word_counts(docs) if counts is None else counts
    held = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = held.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at, to, data, offsets in slices(batch.column(2)):
                ids, around, found = _windows(vocab, data, offsets)
                logs, n = vocab.log_share[ids], np.diff(found.first)
                logs += _log_of(net, around, vocab.classes[ids])
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[found.first])
                other = ids == 0
                pairs = np.column_stack([np.repeat(np.arange(at, to), n)[other], found.hashes[other].view(np.int64)])
                pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
                blank, none = pa.nulls(len(pairs), pa.int64()), pa.nulls(to - at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows[at:to], rows[pairs[:, 0]]])), pa.concat_arrays([batch.column(1).slice(at, to - at), blank]),
                        pa.concat_arrays([pa.array(n.astype(np.int64)), blank]), pa.concat_arrays([pa.array(np.where(n > 0, sums, 0.0)), pa.nulls(len(pairs), pa.float64())]),
                        pa.concat_arrays([none, pa.array(pairs[:, 1])]), pa.concat_arrays([none, pa.array(times.astype(np.int64))]),
                    ],
                    ["row", "doc_id", "n_words", "log_prob", "word", "n"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = saved(numbered.mapInArrow(total, "row long, doc_id long, n_words long, log_prob double, word long, n long"))
    known = docs.sparkSession.createDataFrame(pd.DataFrame({"word": vocab.hashes.view(np.int64)}), "word long")
    others = counts.join(F.broadcast(known), "word", "left_anti")
    rest = float(others.agg(F.sum("times")).first()[0] or 1)
    tail = (
        parts.where("word IS NOT NULL").select("row", "word", "n").join(others, "word", "left")
        .groupBy("row").agg(F.sum(F.col("n") * F.round(F.log(F.coalesce("times", F.lit(1)) / F.lit(rest)) * _FINE).cast("long")).alias("fine"))
    )
    whole = F.col("log_prob") + F.coalesce(F.col("fine") / _FINE, F.lit(0.0))
    return (
        parts.where("word IS NULL AND n_words IS NOT NULL").join(tail, "row", "left")
        .select("doc_id", "n_words", whole.alias("log_prob"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_prob"))
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Count, train and score over the same documents; see `score`."""
    counts = word_counts(docs)
    vocab = vocabulary(docs, counts)
    return score(docs, vocab, fit(docs, vocab), counts)
