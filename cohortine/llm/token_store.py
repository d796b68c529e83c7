"""Token ids in ORC: integer run-length encoded lists, row indexes and Bloom filters on document ids.

Texts are dealt into ranges of doc_id, sorted, and tokenised where they are written; each task writes one file with the
place of every document among its own ids. A file holds stripes that separate tasks read, so reading needs no order;
the first id of a file among all ids is the sum of the files before it. A lookup by doc_id opens only stripes and row
groups whose statistics and Bloom filter admit it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text_keys import LOWER, SPACED, slices, span_hashes, spans

END_ID = 1
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ORC = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20), "compression": "zstd",
}
#: Distinct pieces of text whose ids a worker remembers (some 40 bytes each); past it the memory starts anew.
REMEMBERED = 2_000_000
_SLICE = 1 << 20
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer that remembers the ids of pieces of text.

    It is for tokenizers that drop white space and never join what white space separates, nor a letter and a final
    full stop, comma, colon, semicolon, question or exclamation mark; then the ids of a text are those of its pieces in
    order. Pieces are known by their 64-bit hashes. Texts that may hold a special token are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = [t.ids for t in self.tokenizer.encode_batch(["AZ", "az"], add_special_tokens=False)]
        self.lowers = self.lowers[0] == self.lowers[1]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Add pieces with new, sorted hashes."""
        for at in range(0, len(pieces), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 10_000], add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(flat), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(size) - size
            self.used += len(flat)
            own = hashes[at : at + 10_000]
            place = np.searchsorted(self.hashes, own)
            self.hashes, self.begin, self.size = (np.insert(x, place, y) for x, y in ((self.hashes, own), (self.begin, begin), (self.size, size)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text and where each text's ids begin; null is empty."""
        ids, sizes = [], []
        for at, to, data, offsets in slices(texts, _SLICE):
            if b"<|" in data.tobytes():
                whole = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts[at:to].to_pylist()], add_special_tokens=False)]
                ids += [np.array(x, np.int32) for x in whole]
                sizes.append(np.array([len(x) for x in whole], np.int64))
                continue
            own, bounds = self._pieces(LOWER[data] if self.lowers else data, offsets)
            ids.append(own)
            sizes.append(np.diff(bounds))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), bounds

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, _ = spans(data, offsets, SPACED)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        other = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))
        cut = other[ends - 1] + 1
        latin = (data[np.maximum(cut - 2, 0)] == 0xC3) & (data[cut - 1] != 0x97) & (data[cut - 1] != 0xB7)  # U+00C0 to U+00FF
        cut = cut[(cut > starts) & (cut < ends) & (_LETTER[data[cut - 1]] | latin & (cut > starts + 1))]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        hashes, one, code = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            text = data.tobytes()
            self.learn(hashes[new], [text[a:b].decode() for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            place = np.searchsorted(self.hashes, hashes)
        begin, size = self.begin[place][code], self.size[place][code].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(starts, offsets)]


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and where each text's ids begin; see `Encoder` for what is asked of the tokenizer."""
    return _encoder(path).encode(texts)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every whole text (null: empty), append `end_id`, and write the ids in ascending doc_id order.

    Null doc_ids come first, repeated ones side by side in the order of their texts; other columns are not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                ids, bounds = encode(rows.column(1), tokenizer)
                n = len(rows)
                ends = bounds[1:] + np.arange(1, n + 1)
                out = np.full(len(ids) + n, end_id, np.int32)
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                offsets = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(np.full(n, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out)),
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += len(out)

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(store, SCHEMA).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of given documents, pruned by the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy().astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.mapInArrow(check, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long").join(files, "part").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
