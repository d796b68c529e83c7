"""N-gram Jaccard self-join by token-combination prefixes.

The tokens of a document are its distinct word shingles, ordered by a global order: rare classes of tokens first, the
frequent ones by their count, equal ones by hash. For a similarity of t the overlap of a document of n tokens with any
partner is at least o = ceil(t * n), so partners share a token among the first n - o + 1, and k tokens among the first
n - o + k. Therefore:

* rare tokens among the first n - o + 1 are indexed alone; their groups are small by construction: a token is rare if
  its bucket of a count sketch over all documents is no larger than chance explains, that is within five standard
  deviations of the mean, so the documents of a rare token grow with the square root of the corpus;
* if the least shared token is frequent, so are all shared ones, since rare ones come first. Then only documents of at
  least o frequent tokens matter (a frequent passage in an otherwise rare text indexes nothing), all their r rare tokens
  are among the n - o that the partner lacks, and at most d = floor(n * (1 - t) / t) - r frequent tokens are not shared
  by either. These cannot part all neighbours among the first d + 2 shared tokens, so two tokens that are neighbours in
  the order of frequent tokens are neighbours for the partner too. The prefix is extended to the first
  n - o - r + d + 2 frequent tokens, and every two neighbours in it are an indexed combination: as many as the prefix
  has tokens, whatever the size of the document. Sets too small to have d + 2 shared tokens (fewer than 4 tokens at
  0.75) index frequent tokens alone as well.

Documents with equal sets are one class first. Candidates must pass bounds on length and position, then on parity bit
maps (whose distance never exceeds that of the sets; a short one inside the last join), and are verified on the whole sets. To link a group without
forming all its pairs, each member is first held against one leader, the least of those of its keys, then against the
leader of each key that holds several components; what is then connected needs no further pair, and all remaining
candidates between different components are verified. These meet at few of the keys they share: of the keys that hold
the same documents the first one is enough, and a pair whose first keys show that it has met before makes no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .scratch import few, saved
from .text_keys import SPACED, mix, shingle_sets, slices, words

#: Bits of the count sketch.
SKETCH = 17
SHINGLE = 5
PERCENT = 75
#: Longs of the short parity map, of 64 bits each, that the last join compares before it makes a pair.
FOLDS = 4
#: First keys of a class that tell the last join whether a pair has met at an earlier one.
HEADS = 16


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column):
        yield from shingle_sets(words(data, offsets, SPACED), shingle)


def _parity(tokens: np.ndarray) -> bytes:
    """For each of 2 ** b bits, about two a token, whether an odd number of tokens fall on it."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(tokens: np.ndarray) -> np.ndarray:
    """A parity map of 64 * FOLDS bits, one a token, as longs."""
    odd = np.bincount((tokens & np.uint64(64 * FOLDS - 1)).astype(np.int64), minlength=64 * FOLDS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n, f1, f2, cls, parity, p0, p1, ...) of each row; rows with n null carry the count sketch: (bucket, times)."""

    folds = [f"p{i}" for i in range(FOLDS)]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH, np.int64)
        names = ["doc_id", "n", "f1", "f2", "cls", "parity", *folds, "bucket", "times"]
        for batch in batches:
            rows = []
            for s in _sets(batch.column(1), shingle):
                sketch += np.bincount((s >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) if len(s) > 1 << SKETCH else 0
                if len(s) <= 1 << SKETCH:
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
                f1, f2 = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0)
                rows.append((len(s), f1, f2, _parity(s), _folded(s)))
            n, f1, f2, parity, short = zip(*rows) if rows else ((), (), (), (), ())
            short = np.array(short, np.int64).reshape(-1, FOLDS)
            f1, f2 = np.array(f1, np.uint64), np.array(f2, np.uint64)
            cls = mix(f1 ^ mix(f2 + np.array(n, np.uint64)))
            blank = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (f1, f2, cls)), pa.array(parity, pa.binary()), *(pa.array(short[:, i]) for i in range(FOLDS)), blank, blank], names
            )
        used = np.flatnonzero(sketch)
        blank = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([blank] * 5 + [pa.nulls(len(used), pa.binary()), *[blank] * FOLDS, pa.array(used), pa.array(sketch[used])], names)

    return docs.select("doc_id", "text").mapInArrow(
        profile, f"doc_id long, n long, f1 long, f2 long, cls long, parity binary, {', '.join(f'{p} long' for p in folds)}, bucket long, times long"
    )


def _frequent(sketch: DataFrame) -> np.ndarray:
    """The count of each bucket, 0 where chance explains it. 2 ** SKETCH rows reach the driver."""
    counts = np.zeros(1 << SKETCH, np.int64)
    for row in sketch.groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        counts[row.bucket] = row.times
    mean = counts.mean()
    return np.where(counts > mean + 5 * math.sqrt(mean) + 16, counts, 0)


def _keys(s: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexed tokens and combinations of a set of tokens with these counts (0: rare): key, place in the order, frequent."""
    n = len(s)
    least = -(-percent * n // 100)
    order = np.argsort(count, kind="stable")
    token, rare = s[order], n - int(np.count_nonzero(count))
    alone = np.arange(n - least + 1)
    if n * (2 * percent - 100) >= 200:
        alone = alone[:rare]
    key, place, often = [token[alone]], [alone], [alone >= rare]
    if rare < n and n - rare >= least:
        apart = n * (100 - percent) // percent - rare
        held = token[rare : rare + n - least - rare + max(0, apart) + 2]
        key.append(mix(held[:-1] * np.uint64(3) + mix(held[1:])))
        place.append(rare + np.arange(len(held) - 1))
        often.append(np.ones(len(held) - 1, bool))
    return np.concatenate(key), np.concatenate(place), np.concatenate(often)


def _index(docs: DataFrame, counts: np.ndarray, percent: int, shingle: int) -> DataFrame:
    """(token key, class, n, position, frequent tokens before a frequent one, frequent) of the indexed tokens and combinations of every row."""
    counts = counts.tobytes()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.frombuffer(counts, np.int64)
        for batch in batches:
            keys, places, before, marks, classes, sizes, held = [], [], [], [], [], [], 0
            for s in _sets(batch.column(0), shingle):
                n = len(s)
                if not n:
                    continue
                count = frequency[(s >> np.uint64(64 - SKETCH)).astype(np.int64)]
                key, place, often = _keys(s, count, percent)
                f2 = np.bitwise_xor.reduce(mix(s))
                cls = mix(np.array([s.sum(dtype=np.uint64)]) ^ mix(np.array([f2 + np.uint64(n)], np.uint64)))
                keys.append(key)
                places.append(place)
                before.append(np.where(often, place - (n - np.count_nonzero(count)), 0))
                marks.append(often)
                classes.append(np.repeat(cls, len(key)))
                sizes.append(np.full(len(key), n))
                held += len(key)
                if held > 100_000:
                    yield _rows(keys, classes, sizes, places, before, marks)
                    keys, places, before, marks, classes, sizes, held = [], [], [], [], [], [], 0
            if held:
                yield _rows(keys, classes, sizes, places, before, marks)

    return docs.select("text").mapInArrow(index, "key long, cls long, n int, place int, before int, often boolean")


def _one_each(docs: DataFrame, rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Documents and profiles with one row for each doc_id: the one with the most shingles, of these the one with the
    greatest fingerprint; rows that are still equal have equal sets. Without repeated ids nothing is moved."""
    many = saved(rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"))
    if many.isEmpty():
        return docs, rows
    many = few(many)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), shingle))
            n, sums = [len(s) for s in sets], np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            mixed = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(sums.view(np.int64)), pa.array(mixed.view(np.int64))], ["doc_id", "text", "n", "f1", "f2"])

    weighed = docs.join(many, "doc_id", "left_semi").mapInArrow(weigh, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n long, f1 long, f2 long")
    picked = saved(weighed.groupBy("doc_id").agg(F.max_by("text", F.struct("n", "f1", "f2")).alias("text")))
    rows = rows.join(many, "doc_id", "left_anti").select(*rows.columns).union(profiles(picked, shingle).where("n IS NOT NULL"))
    return docs.join(many, "doc_id", "left_anti").select("doc_id", "text").union(picked.select("doc_id", "text")), rows


def _rows(keys: list, classes: list, sizes: list, places: list, before: list, marks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes).view(np.int64)),
            *(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, places, before)), pa.array(np.concatenate(marks)),
        ],
        ["key", "cls", "n", "place", "before", "often"],
    )


def _possible(side: str, other: str, percent: int) -> Column:
    """Bounds on length and, from the places of a shared token, on the overlap: a rare one may be the least shared token
    (before is 0); before a frequent one other frequent ones may be shared, but no rare ones, as they would be met first."""
    n, place, before, other_n, other_place, other_before = (F.col(x + c) for x in (side, other) for c in ("n", "place", "before"))
    overlap = F.least(n - place, other_n - other_place) + F.least(before, other_before)
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & ((100 + percent) * overlap >= percent * (n + other_n))


def _alike(n: Column, other_n: Column, percent: int, other: str = "o") -> Column:
    """Whether the short parity maps allow the similarity: their distance never exceeds that of the sets."""
    apart = sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"{other}p{i}"))) for i in range(FOLDS))
    return (100 + percent) * apart <= (100 - percent) * (n + other_n)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose parity bit maps allow the similarity."""
    left = classes.select(F.col("cls").alias("a"), F.col("parity").alias("pa"), F.col("n").alias("na"))
    right = classes.select(F.col("cls").alias("b"), F.col("parity").alias("pb"), F.col("n").alias("nb"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 4))
            total = (batch.column(3).to_numpy() + batch.column(5).to_numpy()).tolist()
            keep = []
            for x, y, n in zip(a, b, total):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append((100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * n)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "na", "pb", "nb").mapInArrow(allow, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of representatives' doc_ids whose whole sets have the similarity."""
    ids = classes.select("cls", "rep")
    pairs = saved(
        pairs.join(ids.withColumnsRenamed({"cls": "a", "rep": "x"}), "a").join(ids.withColumnsRenamed({"cls": "b", "rep": "y"}), "b").select("x", "y").distinct()
    )
    ends = pairs.select(F.col("x").alias("doc_id")).union(pairs.select(F.col("y").alias("doc_id"))).distinct()
    bitmap = bloom.fill(ends.select(F.xxhash64("doc_id").alias("h")), "h")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.holds(bitmap, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                tokens = pa.array([s.tobytes() for s in _sets(part.column(1), shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], ["doc_id", "tokens"])

    whole = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(sets, "doc_id long, tokens binary")
    whole = saved(whole.join(ends, "doc_id", "left_semi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(whole.withColumnsRenamed({"doc_id": "x", "tokens": "tx"}), "x")
        .join(whole.withColumnsRenamed({"doc_id": "y", "tokens": "ty"}), "y")
        .select("x", "y", "tx", "ty").mapInArrow(compare, "a long, b long")
    )


def _mixed(shared: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, cls, n, place, before, often, component) of the keys that hold several components."""
    placed = shared.join(classes.select("cls", F.col("rep").alias("node")), "cls").join(groups, "node", "left").select(
        "key", "cls", "n", "place", "before", "often", F.coalesce("component", "node").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return saved(placed.join(mixed, "key", "left_semi"))


def _once(placed: DataFrame) -> DataFrame:
    """The rows of the first of the keys that hold the same classes, with `met`: those of the first HEADS keys of the class
    that come before the row's.

    Keys come in one order, rare tokens first and in the order of the sets. The least key that two classes share is the
    first of those that hold the same classes, and no key that both have met comes before it: so a pair that makes no row
    where its `met` have a key in common still makes one at its least key, where its bounds are those of its least token.
    """
    placed = placed.withColumn("turn", F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    lists = placed.groupBy("turn").agg(
        F.max("often").alias("often"), F.count("*").alias("m"), F.expr("bit_xor(cls)").alias("x"), F.expr("bit_xor(xxhash64(cls))").alias("y")
    )
    firsts = lists.groupBy("often", "m", "x", "y").agg(F.min("turn").alias("turn")).select("turn")
    placed = saved(placed.join(firsts, "turn", "left_semi"))
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("often", "turn"))
    heads = placed.select("cls", "often", "turn", nth.alias("nth")).where(F.col("nth") <= HEADS).groupBy("cls").agg(F.collect_list(F.struct("often", "turn")).alias("heads"))
    met = F.transform(F.filter("heads", lambda h: h < F.struct("often", "turn")), lambda h: h["turn"])
    return placed.join(heads, "cls").withColumn("met", met).drop("heads", "turn")


def similar_documents(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's shingle set and the smallest doc_id it reaches.

    Two documents link when their sets' Jaccard similarity is percent / 100 or more. A null, empty or blank text has no
    shingles and links with nothing. Rows with a null doc_id take no part. Rows that repeat a doc_id are one document
    with the text of one of them, whatever their order: that with the most shingles, of these that with the greatest
    fingerprint. The texts of the others take no part. Other columns are not read.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows, folds = saved(profiles(docs, shingle)), [f"p{i}" for i in range(FOLDS)]
    counts = _frequent(rows.where("n IS NULL"))
    docs, rows = _one_each(docs, rows.where("n IS NOT NULL"), shingle)
    classes = saved(
        rows.where("n > 0").groupBy("f1", "f2", "n", "cls").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity"), *[F.first(p).alias(p) for p in folds])
    )
    index = _index(docs, counts, percent, shingle)
    lead = Window.partitionBy("key").orderBy("cls", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = (
        index.where("NOT often")
        .select("key", "cls", "n", "place", "before", *(F.first(c).over(lead).alias(f"l{c}") for c in ("cls", "n", "place", "before")), F.max("cls").over(lead).alias("hi"), F.min("cls").over(lead).alias("lo"))
        .where("hi <> lo").drop("hi", "lo").distinct().withColumn("often", F.lit(False))
    )
    often = saved(index.where("often").groupBy("key", "cls").agg(*[F.min(c).alias(c) for c in ("n", "place", "before")]))
    # the least class leads, so that the keys of a group of near copies have few leaders among them
    leaders = often.groupBy("key").agg(F.min(F.struct("cls", "place", "n", "before")).alias("l"), F.count("*").alias("m")).where("m > 1")
    often = often.join(leaders, "key").select("key", "cls", "n", "place", "before", *(F.col(f"l.{c}").alias(f"l{c}") for c in ("cls", "n", "place", "before")), F.lit(True).alias("often"))
    shared = saved(rare.union(often))

    fits = _possible("", "l", percent)
    ordered = F.least("cls", "lcls").alias("a"), F.greatest("cls", "lcls").alias("b")
    check = lambda pairs: saved(_verified(_near(pairs.distinct(), classes, percent), docs, classes, percent, shingle))

    # Each member against one leader: the least of those of its keys. A group of near copies has one in common.
    firsts = shared.where("cls <> lcls").where(fits).groupBy("cls").agg(F.min("lcls").alias("lcls"))
    links = check(firsts.select(*ordered))

    # What is not connected yet, against the leader of each key that holds several components.
    led = _mixed(shared, classes, components(links))
    leaders = led.groupBy("key").agg(F.min(F.struct("cls", "place", "n", "before", "component")).alias("l"))
    led = led.join(leaders, "key").select(
        "cls", "n", "place", "before", "component", *(F.col(f"l.{c}").alias(f"l{c}") for c in ("cls", "n", "place", "before", "component")),
    )
    links = links.union(check(led.where("component <> lcomponent").where(fits).select(*ordered)))

    # What is still not connected: candidates between different components of a key, each pair once.
    placed = _once(_mixed(shared, classes, components(links))).drop("often").join(classes.select("cls", *folds), "cls")
    other = placed.select(*(F.col(c).alias(f"o{c}") for c in placed.columns))
    rest = (
        placed.join(other, (F.col("key") == F.col("okey")) & (F.col("cls") < F.col("ocls")) & (F.col("component") != F.col("ocomponent"))
                    & _possible("", "o", percent) & _alike(F.col("n"), F.col("on"), percent) & ~F.arrays_overlap("met", "omet"))
        .select(F.col("cls").alias("a"), F.col("ocls").alias("b"))
    )
    groups = components(links.union(check(rest)))

    return (
        rows.select("doc_id", "f1", "f2", "n").join(classes.select("f1", "f2", "n", F.col("rep").alias("node")), ["f1", "f2", "n"], "left").join(groups, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    )
