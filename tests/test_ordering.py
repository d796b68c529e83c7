"""Cut orders against brute force, with groups so hot that every path is taken."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortine.operators import ordering as o
from cohortine.operators.joins import near_any, nearest_join


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hot = [("hot", rng.choice([rng.randint(0, 40), rng.randint(0, 4000)]), i) for i in range(600)]
    cold = [(f"k{i % 90}", rng.randint(0, 50), 1000 + i) for i in range(400)]
    return hot + cold


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, x bigint, id bigint").repartition(7)


def groups(rows):
    out = {}
    for k, x, i in rows:
        out.setdefault(k, []).append((x, i))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot_rows", [5, 100, 10_000])
def test_number_rows(table, rows, hot_rows):
    got = o.number_rows(table, ["k"], [F.col("x"), F.col("id")], F.col("x"), "rn", hot_rows).collect()
    want = {(k, i): n for k, v in groups(rows).items() for n, (_, i) in enumerate(v, 1)}
    assert {(r.k, r.id): r.rn for r in got} == want


def test_number_rows_descending(table, rows):
    got = o.number_rows(table, ["k"], [F.col("x").desc(), F.col("id")], -F.col("x"), "rn", 20).collect()
    want = {}
    for k, v in groups(rows).items():
        for n, (_, i) in enumerate(sorted(v, key=lambda t: (-t[0], t[1])), 1):
            want[(k, i)] = n
    assert {(r.k, r.id): r.rn for r in got} == want


def test_cells_are_even_where_values_crowd(spark):
    """95 % of a group at one end, a tenth of another in one value, a third group small."""
    rows = [("end", 1e9 if i % 20 == 0 else i / 1e4) for i in range(20_000)] + [("tie", 5.0 if i % 10 == 0 else float(i)) for i in range(20_000)]
    rows += [("small", float(i)) for i in range(90)] + [("end", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    cells = o.cut(df, ["k"], F.col("x"), o.splits(df, ["k"], F.col("x"), 100)).groupBy("k", "__cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k", "__cell").collect()
    size = {k: [(r.n, r.lo, r.hi) for r in cells if r.k == k] for k in ("end", "tie", "small")}
    assert [n for n, _, _ in size["small"]] == [90]
    for k, heavy in (("end", 1e9), ("tie", 5.0)):
        assert all(a[2] < b[1] for a, b in zip(size[k], size[k][1:]))
        spread = [n for n, lo, hi in size[k] if not lo <= heavy <= hi]
        assert len(spread) > 100 and max(spread) <= 2 * sum(spread) / len(spread)
    end = df.where("k = 'end'")
    whole = o.cut(end, [], F.col("x"), o.splits(end, [], F.col("x"), 5_000)).groupBy("__cell").count().collect()
    assert 3 <= len(whole) <= 6


def test_running_totals_are_cut(table, rows):
    dense = table.groupBy("k", "x").agg(F.count("*").alias("n"))
    for size in (7, 10_000):
        got = {(r.k, r.x): (r.cum_n, r.all_n) for r in o.running_totals(dense, ["k"], "x", ["n"], size).collect()}
        assert got == {(k, x): (sum(y <= x for y, _ in v), len(v)) for k, v in groups(rows).items() for x, _ in v}


def test_running_totals_and_mid_ranks(table, rows):
    got = {(r.k, r.x): (r.n, r.mid_rank, r.all_n) for r in o.mid_ranks(table, ["k"], "x").collect()}
    for k, v in groups(rows).items():
        xs = [x for x, _ in v]
        for x in set(xs):
            below, ties = sum(y < x for y in xs), xs.count(x)
            assert got[(k, x)] == (ties, below + (ties + 1) / 2, len(xs))
    xs = sorted(r[1] for r in rows)
    whole = {r.x: r.mid_rank for r in o.mid_ranks(table, [], "x").collect()}
    assert all(whole[x] == xs.index(x) + (xs.count(x) + 1) / 2 for x in set(xs))


def test_group_medians_and_modes(table, rows):
    med = {r.k: r.median for r in o.group_medians(table, ["k"], "x").collect()}
    mode = {r.k: r.mode for r in o.group_modes(table, ["k"], "x").collect()}
    for k, v in groups(rows).items():
        xs = [x for x, _ in v]
        assert med[k] == statistics.median(xs)
        assert mode[k] == min(xs, key=lambda x: (-xs.count(x), x))


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_ordered_gaps(table, rows, hot_rows):
    got = {}
    for r in o.ordered_gaps(table, ["k"], "x", rows_per_cell=hot_rows).collect():
        got.setdefault(r.k, []).append(r.gap)
    for k, v in groups(rows).items():
        xs = [x for x, _ in v]
        assert sorted(got.get(k, [])) == sorted(b - a for a, b in zip(xs, xs[1:]))


def test_hash_positions(table, rows):
    t = table.withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = {(r.k, r.id): r.rn for r in o.hash_positions(t, ["k"], "h").collect()}
    assert len(got) == len(rows)
    import hashlib

    for k, v in groups(rows).items():
        ids = sorted((i for _, i in v), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
        assert [got[(k, i)] for i in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_nearest_join(table, rows, hot_rows):
    p, t = table.where("id % 3 > 0"), table.where("id % 3 = 0").select("k", F.col("x").alias("y"))
    got = {(r.k, r.id): r.nearest for r in nearest_join(p, t, ["k"], "x", "y", rows_per_cell=hot_rows).collect()}
    for k, v in groups(rows).items():
        ys = [x for x, i in v if i % 3 == 0]
        for x, i in v:
            if i % 3:
                want = min(ys, key=lambda y: (abs(y - x), y)) if ys else None
                assert got[(k, i)] == want


@pytest.mark.parametrize("reach", [1, 7, 250])
def test_near_any(table, rows, reach):
    p, t = table.where("id % 5 > 0"), table.where("id % 5 = 0").select("k", F.col("x").alias("y"))
    got = {(r.k, r.id): r.near for r in near_any(p, t, ["k"], "x", "y", reach).collect()}
    for k, v in groups(rows).items():
        ys = [x for x, i in v if i % 5 == 0]
        assert all(got[(k, i)] == any(abs(y - x) <= reach for y in ys) for x, i in v if i % 5)
