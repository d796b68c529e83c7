"""Reference and predictions meet once for each side, not once for each seed."""

import itertools
import math
import re

import pytest

from cohortine.operators import evaluation as ev

SEEDS = [0, 1]
STONES = [(1, "RIGHT", "UPPER", "SMALL"), (1, "RIGHT", "MID", "LARGE"), (1, "LEFT", "MID", "SMALL"), (2, "LEFT", "LOWER", None), (None, "LEFT", "MID", "SMALL")]
PREDS = [
    (0, 1, "RIGHT", 0.9, "MID", "LARGE", True), (1, 1, "RIGHT", 0.2, "MID", "LARGE", True), (0, 1, "LEFT", 0.9, "MID", None, True),
    (0, 1, "LEFT", 0.8, "MID", "SMALL", True), (7, 2, "LEFT", 0.9, "LOWER", "SMALL", True), (0, 3, "LEFT", 0.7, "MID", "SMALL", False),
    (None, 2, "LEFT", 0.9, "LOWER", "SMALL", True), (0, None, "LEFT", 0.9, "MID", "SMALL", True),
]


@pytest.fixture(scope="module")
def tables(spark):
    stones = spark.createDataFrame(STONES, "case_id int, side string, zone string, cls string")
    preds = spark.createDataFrame(PREDS, "seed int, case_id int, side string, p double, zone string, size_cls string, has_stone boolean")
    return preds.selectExpr("*", "cast(NULL AS string) AS max_class"), stones


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_are_those_of_a_full_join_for_each_seed(tables):
    preds, stones = tables
    units = ev.reference_units(preds, stones, "zone", "cls", SEEDS)
    got = sorted(((r.seed, r.case_id, r.side, r.present, r.has_stone, r.ref and tuple(r.ref)) for r in units.collect()), key=str)
    refs = {(1, "RIGHT"): ("MID", "LARGE"), (1, "LEFT"): ("MID", "SMALL"), (2, "LEFT"): ("LOWER", None)}
    want = [(s, c, d, p > 0.5, has, refs.get((c, d)) if s in SEEDS else None) for s, c, d, p, _, _, has in PREDS]
    seen = {(s, c, d) for s, c, d, *_ in PREDS}
    want += [(s, c, d, False, True, r) for (c, d), r in refs.items() for s in SEEDS if (s, c, d) not in seen]
    want += [(s, None, "LEFT", False, True, ("MID", "SMALL")) for s in SEEDS]
    assert got == sorted(want, key=str)


def test_no_seed_is_a_key_of_a_shuffle_of_units(tables, spark):
    preds, stones = tables
    units = ev.reference_units(preds, stones, "zone", "cls", SEEDS)
    cases = ev.case_sides(units, spark.range(4).selectExpr("cast(id AS int) AS case_id"), SEEDS)
    assert not re.search(r"hashpartitioning\([^)]*seed", plan_of(cases))
    got = {(r.seed, r.case_id): (r.lat_ref, r.lat_pred) for r in cases.collect()}
    assert got == {
        (0, 0): ("NONE", "NONE"), (1, 0): ("NONE", "NONE"), (0, 1): ("BILATERAL", "BILATERAL"), (1, 1): ("BILATERAL", "NONE"),
        (0, 2): ("LEFT", "NONE"), (1, 2): ("LEFT", "NONE"), (0, 3): ("NONE", "LEFT"), (1, 3): ("NONE", "NONE"),
    }


def test_own_predictions_are_a_left_join_without_a_shuffle_by_seed(tables):
    preds, _ = tables
    df = ev.own_predictions(preds, preds["case_id"] != 3)
    assert not re.search(r"hashpartitioning\([^)]*seed", plan_of(df))
    want = []
    for s, c, d, *_, has in PREDS:
        mates = [(p > 0.5, (z, k) if p > 0.5 and k else None) for t, b, e, p, z, k, _ in PREDS if s is not None and c not in (None, 3) and (t, b, e) == (s, c, d)]
        want += [(s, c, d, has, *m) for m in mates or [(None, None)]]
    got = [(r.seed, r.case_id, r.side, r.has_stone, r.present, r.guess and tuple(r.guess)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tuples_meet_without_a_join(tables):
    preds, stones = tables
    scores = ev.triplet_scores(preds.where("seed IN (0, 1)"), stones, "zone", "cls", SEEDS)
    assert "Join" not in plan_of(scores)
    got = {(r.seed, r.reference): (r.tp, r.fp, r.fn, r.no_size_pred) for r in scores.collect()}
    assert got == {(0, "complete"): (3, 1, 2, 1), (0, "reduced"): (2, 2, 1, 1), (1, "complete"): (0, 0, 5, 0), (1, "reduced"): (0, 0, 3, 0)}


def test_thresholds_do_not_depend_on_the_order_of_the_folds(spark):
    folds = [0.30209999999999976, 0.3444, 0.3123000000000002, 0.3549000000000001, 0.3212999999999999]  # mean 0.327, one bit off in some orders
    orders = list(itertools.permutations(folds))
    runs = spark.createDataFrame([(i, x, x + 0.3) for i, o in enumerate(orders) for x in o], "seed int, thr_lo double, thr_hi double").coalesce(1)
    rows = spark.createDataFrame([(i, 0.327) for i in range(len(orders))], "seed int, z_hat double")
    out = ev.averaged_thresholds(rows, runs, ["seed"], "z_hat").collect()
    assert len(out) == len(orders) and {r.zone for r in out} == {"MID"}
    means = runs.groupBy("seed").agg(ev.steady_mean("thr_lo").alias("m")).select("m").distinct().collect()
    assert [r.m for r in means] == [math.fsum(folds) / 5]
