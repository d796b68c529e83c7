"""Merkle manifest of a dataset, its nodes stored in van Emde Boas layout.

Every row is a leaf. The leaves of a group, in the order of their ids, are the bottom of a tree of 16-way nodes; the roots
of the groups, in the order of the groups, are the leaves of one more such tree, whose root stands for the dataset.

A tree is cut into aligned blocks of SPAN leaves. A block is a subtree of DEPTH levels above its leaves, stored as one
array of digests in van Emde Boas order: the upper half of its levels first, then the subtrees below it from left to
right, each laid out by the same rule. The place of a node follows from its level and index alone (`address`), so parents
are computed and siblings found by arithmetic, and neighbours of a path lie near each other at every scale. The roots of
the blocks are the leaves of the next round, until a tree has one block; so there are log(leaves) / log(SPAN) rounds, and
a task holds blocks of bounded size. Paths come back the same way: each round hands every block the siblings above it.

Digests are lower-case hexadecimal SHA-256 of concatenated inputs, digests entering as that text; stored ones are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import saved

ARITY = 16
#: Levels of a block above its leaves, of which it has SPAN.
DEPTH = 3
SPAN = ARITY**DEPTH
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: of each value `-` if it is null, else its length in bytes, a colon and itself."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def size(height: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (ARITY**height - 1) // (ARITY - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in a tree with `height` levels of nodes, of the nodes number `index` at `depth` (0 is the root)."""
    if height == 1:
        return np.zeros_like(index)
    upper = height // 2
    if depth < upper:
        return address(upper, depth, index)
    below = ARITY ** (depth - upper)
    return size(upper) + index // below * size(height - upper) + address(height - upper, depth - upper, index % below)


@cache
def _places(height: int, depth: int) -> np.ndarray:
    return address(height, depth, np.arange(ARITY**depth))


def levels_of(n: int, span: int = SPAN) -> int:
    """Levels above the leaves of a block of `span` leaves that belongs to a tree of n leaves."""
    levels, reach = 0, 1
    while reach < min(n, span):
        levels, reach = levels + 1, reach * ARITY
    return levels


def _counts(n_leaves: int, levels: int) -> list[int]:
    """Nodes that exist at each depth."""
    return [-(-n_leaves // ARITY ** (levels - depth)) for depth in range(levels + 1)]


def lay_out(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The nodes above (n, 32) leaves in van Emde Boas order, up to the last place in use; the root is the first."""
    counts = _counts(len(leaves), levels)
    used = max(int(_places(levels + 1, d)[:c].max()) for d, c in enumerate(counts)) + 1
    nodes = np.zeros((used, 32), np.uint8)
    nodes[_places(levels + 1, levels)[: len(leaves)]] = leaves
    for depth in range(levels - 1, -1, -1):
        children = nodes[_places(levels + 1, depth + 1)[: counts[depth + 1]]].tobytes().hex()
        run = 64 * ARITY
        own = b"".join(sha256(children[at : at + run].encode()).digest() for at in range(0, len(children), run))
        nodes[_places(levels + 1, depth)[: counts[depth]]] = np.frombuffer(own, np.uint8).reshape(-1, 32)
    return nodes


def sibling_paths(nodes: np.ndarray, n_leaves: int, levels: int) -> Iterator[list[str]]:
    """For each leaf of a block the digests left and right of its path, level by level: [left, right, left, right, ...]."""
    counts = _counts(n_leaves, levels)
    rows = [nodes[_places(levels + 1, d)[: counts[d]]].tobytes().hex() for d in range(1, levels + 1)][::-1]
    for leaf in range(n_leaves):
        out, at = [], leaf
        for row in rows:
            run = at // ARITY * ARITY * 64
            out += [row[run : at * 64], row[at * 64 + 64 : run + ARITY * 64]]
            at //= ARITY
        yield out


def fold(node: str, path: list[str]) -> str:
    """The root above a leaf, given its siblings."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = sha256((left + node + right).encode()).hexdigest()
    return node


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank` from 0 inside each tree and `total`, its number of leaves, by range partitions: each numbers its own
    rows and the sizes of those before it are added, so a tree with a third of all leaves needs no task of its own."""
    placed = saved(
        leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33).alias("part")
    sums = placed.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("at").alias("start"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"), "start")
    return (
        placed.withColumn("part", part).join(sums, ["tree", "part"])
        .withColumn("rank", F.col("before") + F.col("at") - F.col("start")).drop("part", "at", "before", "start")
    )


def _lay_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = [], []
        for n, span, leaves in zip(*(batch.column(c).to_pylist() for c in ("n", "span", "digests")), strict=True):
            laid = lay_out(np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32), levels_of(n, span))
            nodes.append(laid.tobytes())
            roots.append(nodes[-1][:32])
        kept = ["tree", "block", "n", "span", "n_leaves", "entries"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], [*kept, "nodes", "root"])


def _grow(nodes: DataFrame, path: str, span: int) -> list[DataFrame]:
    """Blocks of each round above nodes (tree, rank, total, digest, entry), written below path."""
    spark, rounds = nodes.sparkSession, []
    while True:
        grouped = nodes.groupBy("tree", F.expr(f"rank div {span}").alias("block")).agg(
            F.max("total").alias("n"), F.count("*").cast("int").alias("n_leaves"), F.sort_array(F.collect_list(F.struct("rank", "digest", "entry"))).alias("own")
        ).select("tree", "block", "n", F.lit(span).alias("span"), "n_leaves", F.col("own.entry").alias("entries"), F.col("own.digest").alias("digests"))
        kinds = dict(grouped.dtypes)
        schema = f"tree string, block long, n long, span int, n_leaves int, entries {kinds['entries']}, nodes binary, root binary"
        target = f"{path}/round={len(rounds)}"
        grouped.mapInArrow(_lay_blocks, schema).write.parquet(target)
        blocks = spark.read.schema(schema).parquet(target)
        rounds.append(blocks)
        more = blocks.where("n > span")
        if more.isEmpty():
            return rounds
        nodes = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / span).alias("total"), F.col("root").alias("digest"), F.lit(None).cast("boolean").alias("entry"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of each block the siblings from there to the root of the dataset."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tree", "block", "n", "span", "n_leaves", "nodes", "above", "subroot")]
        for tree, block, n, span, n_leaves, nodes, above, subroot in zip(*columns, strict=True):
            laid = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
            paths = [own + above for own in sibling_paths(laid, n_leaves, levels_of(n, span))]
            numbers = np.arange(n_leaves, dtype=np.int64) + block * span
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * n_leaves, pa.string()), pa.array(numbers), pa.array(paths, pa.list_(pa.string())), pa.array([subroot] * n_leaves, pa.binary())],
                ["tree", "block", "above", "subroot"],
            )


def _proofs(root: str) -> object:
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "span", "n_leaves", "nodes", "above", "subroot", "entries")]
            for n, span, n_leaves, nodes, above, subroot, entries in zip(*columns, strict=True):
                levels = levels_of(n, span)
                laid, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
                leaves = laid[_places(levels + 1, levels)[:n_leaves]].tobytes().hex()
                for at, own in enumerate(sibling_paths(laid, n_leaves, levels)):
                    leaf, path, entry = leaves[64 * at : 64 * at + 64], own + above, entries[at]
                    folded = fold(entry["presented"] or leaf, path)
                    out.append((entry["doc_id"], leaf, subroot.hex(), root, sha256("".join(path).encode()).hexdigest(), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names[1:-1]), ("verified", pa.bool_())]))

    return prove


def write(docs: DataFrame, path: str, presented: Column | None = None, columns: tuple[str, ...] = LEAF_COLUMNS, group: str = "source", order: str = "doc_id", depth: int = DEPTH) -> None:
    """Write the manifest of docs below path: blocks of the groups' trees (`groups`) and of the tree above them (`root`).

    `presented` is the digest with which a row is presented for verification, null where it is the row's own. A null group
    comes first; groups are ordered by their bytes. Null ids come first, rows that repeat an id are ordered by their digest,
    and equal rows are leaves of their own. Columns that are not named are not read. No rows make no blocks.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"), F.col(f"`{order}`").cast("long").alias("doc_id"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("leaf"),
        (F.lit(None).cast("string") if presented is None else presented).alias("presented"),
    )
    ranked = _numbered(saved(leaves), ["doc_id", "leaf", "presented"])
    rounds = _grow(ranked.select("tree", "rank", "total", F.unhex("leaf").alias("digest"), F.struct("doc_id", "presented").alias("entry")), f"{path}/groups", ARITY**depth)
    tops = tree_roots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root")
    ranked = _numbered(tops, ["name"])
    _grow(ranked.select("tree", "rank", "total", F.col("root").alias("digest"), F.col("name").alias("entry")), f"{path}/root", ARITY**depth)


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of each tree: the root of the one block of its last round."""
    out = None
    for blocks in rounds:
        last = blocks.where("n <= span").select("tree", "root")
        out = last if out is None else out.union(last)
    return out


def _read(spark: SparkSession, path: str) -> list[DataFrame]:
    """The blocks of each round below path."""
    rounds, table = [], spark.read.parquet(path)
    last = table.agg(F.max("round")).first()[0]
    for number in range((last if last is not None else -1) + 1):
        rounds.append(table.where(F.col("round") == number).drop("round"))
    return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Blocks of the first round with the siblings above them and the subroot of their tree; tops (tree, above, subroot)
    holds the siblings above the trees."""
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    below = None
    for blocks in reversed(rounds):
        above = tops.select("tree", "block", "above", "subroot")
        ends = blocks.where("n <= span").join(above, ["tree", "block"])
        found = ends if below is None else ends.unionByName(blocks.where("n > span").join(below, ["tree", "block"]))
        below = saved(found.drop("entries").mapInArrow(_paths, "tree string, block long, above array<string>, subroot binary")) if blocks is not rounds[0] else None
        if below is None:
            return found
    raise ValueError("a manifest has a first round")


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf of a manifest: the roots of its group
    and of the dataset, the digest of its siblings from bottom to top, left to right, and the root that its presented
    digest folds to. An empty manifest gives no rows."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    groups, over = _read(spark, f"{path}/groups"), _read(spark, f"{path}/root")
    if not groups:
        return spark.createDataFrame([], schema)
    root = over[-1].select("root").first()[0].hex()
    # the first round of the tree above the groups names them; its paths are their siblings
    nothing = F.array().cast("array<string>")
    start = over[-1].where("n <= span").select("tree", nothing.alias("above"), F.lit(None).cast("binary").alias("subroot"))
    first = _descend(over, start)
    names = over[0].select("block", "span", F.posexplode("entries").alias("at", "tree")).select((F.col("block") * F.col("span") + F.col("at")).alias("number"), "tree")
    paths = first.drop("entries").mapInArrow(_paths, "tree string, block long, above array<string>, subroot binary")
    tops = names.join(paths.select(F.col("block").alias("number"), "above"), "number").join(tree_roots(groups).withColumnRenamed("root", "subroot"), "tree")
    return _descend(groups, saved(tops.select("tree", "above", "subroot"))).mapInArrow(_proofs(root), schema)
