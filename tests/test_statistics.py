"""Published constants and identities of the statistics."""

import math

import pytest
from pyspark.sql import functions as F

from cohortine.functions import tails
from cohortine.operators import aggregates as agg
from cohortine.operators import folds
from cohortine.operators import statistics as st
from cohortine.operators.sets import multiset_counts
from cohortine.plans.catalogue import ORACLE, QUERIES


def test_mean_and_interval_of_published_seeds(spark):
    v = [0.8872, 0.8513, 0.8821, 0.8718, 0.8872]
    df = spark.createDataFrame([(1, x) for x in v] + [(2, 0.5), (3, float("nan")), (3, 0.1)], "k int, v double")
    r = {x.k: x for x in st.mean_interval(df, ["k"], "v").collect()}
    assert abs(r[1]["mean"] - 0.8759) < 2e-4 and abs(r[1].ci_lo - 0.8571) < 2e-4 and abs(r[1].ci_hi - 0.8947) < 2e-4
    assert (r[2].ci_lo, r[2].ci_hi) == (0.5, 0.5) and r[3].n == 1
    n = {x.k: x for x in st.mean_interval(df.where("k = 2"), ["k"], "v", single="null").collect()}
    assert n[2].ci_lo is None


def test_published_accuracies_and_scores():
    assert abs((325 + 294 + 235) / 975 - 0.8758974) < 1e-6
    assert abs((327 + 302 + 230) / 975 - 0.8810256) < 1e-6
    p, r = 0.5419, 0.5242
    assert abs(2 * p * r / (p + r) - 0.5329) < 1e-4
    assert abs(1 - 0.5242 - 0.4758) < 1e-9


def test_published_fisher(spark):
    rows = [(True, True)] * 2 + [(False, True)] * 15 + [(True, False)] * 5 + [(False, False)] * 368
    df = spark.createDataFrame(rows, "flag boolean, bad boolean")
    r = st.fisher_greater(df, F.col("flag"), F.col("bad")).first()
    assert (r.a, r.b, r.c, r.d) == (2, 15, 5, 368)
    assert abs(r.odds_ratio - 9.813) < 1e-3 and abs(r.p - 0.0331) < 1e-4


def test_published_wilcoxon(spark):
    five = [("five", float(i)) for i in range(1, 6)]
    many = [("many", float(i)) for i in range(1, 26)]
    r = {x.k: x for x in st.wilcoxon(spark.createDataFrame(five + many, "k string, d double"), ["k"], "d").collect()}
    assert r["five"].p_exact == 0.0625
    assert abs(r["many"].z - 4.372) < 1e-3 and abs(r["many"].p_normal - 1.229e-05) < 1e-8


def test_tails_against_direct_sums():
    direct = sum(math.comb(40, k) * 0.3**k * 0.7 ** (40 - k) for k in range(9, 41))
    assert abs(tails.binom_greater_value(9, 40, 0.3) - direct) < 1e-12
    assert abs(tails.chi2_upper_value(5.0, 2) - math.exp(-2.5)) < 1e-14
    assert abs(tails.t_quantile_value(0.975, 4) - 2.7764451051977987) < 1e-9
    assert abs(tails.t_two_sided_value(2.0638985616280205, 24) - 0.05) < 1e-12


def test_auc_edges(spark):
    y = [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([("a", v, float(v)) for v in y] + [("b", 1, 0.3)] + [("c", v, 0.5) for v in y], "k string, y int, p double")
    r = {x.k: x.auc for x in st.roc_auc(df, ["k"], "y", "p").collect()}
    assert r == {"a": 1.0, "b": None, "c": 0.5}
    m = {x.k: x for x in st.binary_metrics(df, ["k"], "y", "p").collect()}
    assert m["a"].acc == 1.0 and m["c"].degenerate and m["b"].acc == 0.0


def test_pooling_identities(spark):
    df = spark.createDataFrame([("one", 0.7), ("same", 0.2), ("same", 0.2), ("big", 900.0), ("big", -900.0)], "k string, x double")
    r = {x.k: x.pooled for x in agg.lse_pool(df, ["k"], "x").collect()}
    assert abs(r["one"] - 0.7) < 1e-12 and abs(r["same"] - 0.2) < 1e-12 and abs(r["big"] - (900 - math.log(2) / 4)) < 1e-9


def test_multiset_match_counts_copies(spark):
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k int, t string")
    t = spark.createDataFrame([(1, "a"), (1, "c"), (1, None)], "k int, t string")
    r = multiset_counts(g, t, ["k", "t"]).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    assert tuple(r) == (1, 2, 2)


def test_thin_strata_follow_the_sequential_rule(spark):
    rows, i = [], 0
    for stratum, n in {"A|S": 2, "A|M": 3, "A|L": 9, "B|S": 4, "B|L": 8, "C|L": 12}.items():
        for _ in range(n):
            rows.append((i, *stratum.split("|"), stratum))
            i += 1
    df = spark.createDataFrame(rows, "patient_id int, parent string, tier string, stratum string")
    got = {r.stratum: r.stratum_used for r in folds.merge_thin(df).collect()}
    # A|S -> A|M (2), A|M -> A|L (its own 3 rows): A|M keeps 2 rows and is still thin, so all fall back
    assert got == {s: s[0] for s in ("A|S", "A|M", "A|L", "B|S", "B|L", "C|L")}
    kept = {r.stratum: r.stratum_used for r in folds.merge_thin(df.where("stratum NOT IN ('A|S', 'B|S')")).collect()}
    assert kept == {"A|M": "A|L", "A|L": "A|L", "B|L": "B|L", "C|L": "C|L"}


@pytest.mark.parametrize("n", [3, 97])
def test_folds_are_balanced_and_leak_free(spark, n):
    df = spark.range(n).select(F.col("id").alias("patient_id"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("s"))
    f = folds.stratified_folds(df, "s", [1, 2])
    sizes = f.groupBy("seed", "fold").count().groupBy("seed").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)
    assert all(r.n_leaks == 0 and r.n_units == n for r in folds.leaks(f).collect())


def test_thresholds_are_broadcast_and_not_the_rows(spark, folder):
    plan = QUERIES["apply_thresholds"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_binomial_sql_holds_on_many_labels(spark, duck):
    many = "WITH labels AS (SELECT range % 20 < 11 AND range <> 1 AS quality FROM range(400000)), " + ORACLE["binom_test"].removeprefix("WITH ")
    k, n, _, p = duck.execute(many).fetchone()
    assert (k, n) == (219999, 400000) and abs(p - tails.binom_greater_value(k, n, 0.55)) < 1e-6
