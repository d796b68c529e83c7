"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and goes to every task; its size is bounded by that sample. Every vector is filed
under the leaf that a descent to nearest centroids reaches. A query takes leaves off a priority queue in the order of
distances to their centroids; how many it visits is calibrated: the visits widen until the neighbours that brute force
finds for some of the queries are reached with the wanted recall. Leaves are held against their visitors in blocks of
bounded size, so a leaf with a third of all vectors is split like any other, and every block keeps its best only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

#: Expected size of the fitting sample, children of a node, sample vectors of a leaf.
SAMPLE = 20_000
BRANCH = 8
LEAF = 64
#: Vectors and queries of a block.
BLOCK = 4096
#: Queries that brute force answers for the calibration, recall to reach on them.
CALIBRATION = 64
RECALL = 0.97


class Tree(NamedTuple):
    """Centroids of all nodes; node 0 is the root. children[i] is empty for a leaf."""

    centroids: np.ndarray
    children: list[list[int]]


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most k clusters, none of them empty."""
    random = np.random.default_rng(seed)
    centers = points[random.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centers)
        centers = np.stack([points[own == i].mean(axis=0) for i in np.unique(own)])
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)


def fit_tree(points: np.ndarray, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """Split the points recursively until `leaf` or fewer are left or they do not part any more."""
    centroids, children = [points.mean(axis=0)], [[]]
    todo = [(0, points)]
    while todo:
        node, own = todo.pop()
        if len(own) <= leaf:
            continue
        centers = _kmeans(own, branch, node)
        at = _nearest(own, centers)
        if len(np.unique(at)) < 2:
            continue
        for i in np.unique(at):
            children[node].append(len(centroids))
            todo.append((len(centroids), own[at == i]))
            centroids.append(centers[i])
            children.append([])
    return Tree(np.stack(centroids), children)


def file_under(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if not tree.children[node] or not len(rows):
            out[rows] = node
            continue
        at = _nearest(points[rows], tree.centroids[tree.children[node]])
        todo += [(child, rows[at == i]) for i, child in enumerate(tree.children[node])]
    return out


def visits(tree: Tree, query: np.ndarray, most: int) -> list[int]:
    """The first `most` leaves of a best-bin-first traversal."""
    queue, out = [(0.0, 0)], []
    while queue and len(out) < most:
        _, node = heapq.heappop(queue)
        below = tree.children[node]
        if not below:
            out.append(node)
            continue
        for d, child in zip(((tree.centroids[below] - query) ** 2).sum(axis=1).tolist(), below):
            heapq.heappush(queue, (d, child))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles), one row of each id: nulls, zeros, non-finite vectors and null ids are left out,
    of a repeated id the least vector stays, and of vectors of several lengths those of the commonest."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select("vec_id", v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    size = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size")
    return good.join(F.broadcast(size), F.size("embedding") == F.col("size")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the points, itself left out: exact distances, ties to smaller ids."""
    squares = (points**2).sum(axis=1)
    for number, q in zip(query_ids.tolist(), queries):
        rough = squares - 2 * points @ q + q @ q
        slack = 1e-9 * (squares + q @ q)
        able = np.flatnonzero(ids != number)
        if len(able) > k:
            bound = np.partition((rough + slack)[able], k - 1)[k - 1]
            able = able[(rough - slack)[able] <= bound]
        exact = np.sqrt(((points[able] - q) ** 2).sum(axis=1))
        order = np.lexsort((ids[able], exact))[:k]
        yield number, ids[able][order], exact[order]


def _calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves a query must visit for the recall, by brute force over all rows for CALIBRATION queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toPandas()
    numbers, points = some["vec_id"].to_numpy(), np.stack(some["embedding"].to_list())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), _matrix(batch.column(1))
            leaf = dict(zip(ids.tolist(), file_under(tree, own).tolist()))
            for number, found, far in _best(ids, own, numbers, points, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), pa.array(found), pa.array(far), pa.array([leaf[i] for i in found.tolist()], pa.int64())], ["query_id", "vec_id", "score", "leaf"])

    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = rows.mapInArrow(nearest, "query_id long, vec_id long, score double, leaf long").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).toPandas()
    n_leaves = sum(not c for c in tree.children)
    order = {n: {leaf: i for i, leaf in enumerate(visits(tree, q, n_leaves))} for n, q in zip(numbers.tolist(), points)}
    needed = np.sort([order[q][leaf] + 1 for q, leaf in zip(true["query_id"], true["leaf"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query among all other vectors.

    Euclidean distance in double precision, ties to the smaller vec_id; see `usable` for the vectors that take part.
    With k or fewer others, all are returned. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors))
    total = rows.count()
    queries = rows.where(is_query)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))).orderBy("vec_id").toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total or queries.isEmpty():
        return empty
    tree = fit_tree(np.stack(drawn["embedding"].to_list())) if len(drawn) else Tree(np.zeros((1, 1)), [[]])
    most = _calibrated(rows, queries, tree, k, recall) if len(tree.centroids) > 1 else 1
    held = spark.sparkContext.broadcast(tree)

    def file_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(file_under(held.value, _matrix(batch.column(1))))], ["vec_id", "embedding", "leaf"])

    filed = saved(rows.mapInArrow(file_all, "vec_id long, embedding array<double>, leaf long"))
    n_leaves, wanted = sum(not c for c in tree.children), min(k, total - 1)
    found = saved(_compared(queries, filed, held, most, k, block))
    while most < n_leaves:  # a query whose leaves held too few others visits more of its queue, the same leaves first
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select(F.col("query_id").alias("vec_id"))
        short = saved(queries.join(full, "vec_id", "left_anti"))
        if short.isEmpty():
            break
        most = min(n_leaves, 4 * most)
        more = _compared(short, filed, held, most, k, block)
        found = saved(found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more))
    return found.select("query_id", "rank", "vec_id", "score")


def _compared(queries: DataFrame, filed: DataFrame, held: object, most: int, k: int, block: int) -> DataFrame:
    """(query_id, rank, vec_id, score) over the rows of the first `most` leaves of each query's queue, in blocks of a leaf's
    rows and of its visitors."""

    def visit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [visits(held.value, q, most) for q in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int64()))], ["vec_id", "embedding", "leaves"])

    def compare(own: pa.Table, others: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(own) and len(others):
            ids, points, numbers, ask = (f(t.column(c).combine_chunks()) for t in (own, others) for c, f in (("vec_id", pa.Array.to_numpy), ("embedding", _matrix)))
            found += [(np.full(len(near), number), near, far) for number, near, far in _best(ids, points, numbers, ask, k)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    asked = saved(queries.mapInArrow(visit_all, "vec_id long, embedding array<double>, leaves array<long>").select("vec_id", "embedding", F.explode("leaves").alias("leaf")))
    parts = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = saved(parts(filed, "n_rows").join(parts(asked, "n_asked"), "leaf"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    index = filed.join(sizes, "leaf").select("leaf", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), "n_rows").cast("int").alias("i"), every("n_asked").alias("j"))
    visitors = asked.join(sizes, "leaf").select("leaf", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), "n_asked").cast("int").alias("j"), every("n_rows").alias("i"))
    found = index.groupBy("leaf", "i", "j").cogroup(visitors.groupBy("leaf", "i", "j")).applyInArrow(compare, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
