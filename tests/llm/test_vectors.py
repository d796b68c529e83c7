import math

import numpy as np
from pyspark.sql import functions as F

from cohortine.llm import vector_tree

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, i int"


def exact(points, query, k):
    far = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(points[query], v))), i) for i, v in points.items() if i != query)
    return [(i, d) for d, i in far[:k]]


def test_search(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(12, 8)) * 4
    points = {i: np.float32(centers[i % 12] + rnd.normal(size=8)) for i in range(1500)}
    points |= {i: points[0] for i in range(1500, 2000)}  # a third of all rows are one vector
    rows = [(i, v.tolist(), 0, "l", 1) for i, v in points.items()] + [(0, points[0].tolist(), None, None, None)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 3, []]
    rows += [(3000 + 100 * i, v, None, None, None) for i, v in enumerate(bad)] + [(None, [1.0] * 8, 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = vector_tree.search(df, F.col("vec_id") % 100 == 0, sample=1000, block=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in points if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        true = exact(points, q, 10)
        hits += len({i for i, _ in true} & {i for i, _ in found})
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(abs(d - math.dist(points[q].astype(float), points[i].astype(float))) < 1e-12 for i, d in found)
    assert hits >= 0.9 * 10 * len(got)


def test_small_leaves_widen_their_visits(spark):
    """Outliers alone in their leaves beside a tight cluster that calibrates to one visit still get all their neighbours."""
    rnd = np.random.default_rng(5)
    points = {i: rnd.normal(size=4) * 1e-3 for i in range(1, 3000)} | {100 * i: np.full(4, 50.0 * i) for i in range(1, 6)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "vec_id long, embedding array<double>").repartition(3)
    rows = vector_tree.search(df, F.col("vec_id") % 100 == 0, recall=0.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r["rank"])
    assert set(got) == {i for i in points if i % 100 == 0} and all(g == list(range(1, 11)) for g in got.values())


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, "", 0), (1, [1.0, 3.0], 0, "", 0), (2, [1.0, 1.0], 0, "", 0)], SCHEMA)
    out = vector_tree.search(few, F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert vector_tree.search(few.where("false"), F.lit(True)).count() == 0
    assert vector_tree.search(few, F.lit(False)).count() == 0
    assert vector_tree.search(few.where("vec_id = 0"), F.lit(True)).count() == 0
