"""Statistics over runs, pairs, groups and ranks. Sums run in Spark; only the last step on
aggregated rows calls a tail probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortine.functions import tails
from cohortine.functions.scalars import wilson
from cohortine.operators.ordering import mid_ranks, running_totals
from cohortine.operators.selection import best_and_margin


def _sum(rule: Column) -> Column:
    return F.count_if(rule)


def binary_metrics(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Accuracy with its interval, balanced accuracy, macro F1, majority share, degenerate flag."""
    pos, hit = F.col(y) == 1, F.col(p) >= 0.5
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _sum(pos & hit).alias("tp"), _sum(~pos & hit).alias("fp"),
        _sum(pos & ~hit).alias("fn"), _sum(~pos & ~hit).alias("tn"),
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    low, high = wilson(tp + tn, n)
    f1 = lambda t: F.try_divide(2 * t, 2 * t + fp + fn)
    present = lambda a, b, c: (a + b + c > 0).cast("int")
    labels = present(tp, fp, fn) + present(tn, fp, fn)
    recall = F.array_compact(F.array(F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)))
    mean = F.aggregate(recall, F.lit(0.0), lambda a, x: a + x) / F.size(recall)
    share = (tp + fp) / n
    return g.select(
        *by, "n", "tp", "fp", "fn", "tn", ((tp + tn) / n).alias("acc"), low.alias("acc_lo"), high.alias("acc_hi"),
        mean.alias("bal_acc"),
        ((F.coalesce(f1(tp), F.lit(0.0)) + F.coalesce(f1(tn), F.lit(0.0))) / labels).alias("f1"),
        F.greatest((tp + fn) / n, (tn + fp) / n).alias("majority"),
        (F.greatest(share, 1 - share) >= 0.90).alias("degenerate"),
    )


def roc_auc(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Tie-aware area under the curve; null when only one class occurs.

    Rows collapse to one per distinct score before anything is ordered.
    """
    dense = df.groupBy(*by, p).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    run = running_totals(dense, by, p, ["pos", "neg"])
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(won), F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc")
    )


def class_metrics(df: DataFrame, by: Sequence[str], y: str, guess: str, classes: int) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, quadratic weighted kappa of ordinal classes.

    The expected disagreement of the kappa follows from four sums, so no table of
    marginals is multiplied out.
    """
    t, g = F.col(y), F.col(guess)
    d = lambda c: c.cast("double")
    per = []
    for c in range(classes):
        per += [
            _sum((t == c) & (g == c)).alias(f"h{c}"), _sum(t == c).alias(f"t{c}"), _sum(g == c).alias(f"g{c}"),
        ]
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d((t - g) * (t - g))).alias("__o"), F.sum(d(t)).alias("__t"),
        F.sum(d(g)).alias("__g"), F.sum(d(t * t)).alias("__tt"), F.sum(d(g * g)).alias("__gg"), *per,
    )
    n = F.col("n")
    expected = (n * (F.col("__tt") + F.col("__gg")) - 2 * F.col("__t") * F.col("__g")) / n
    add = lambda cols: F.aggregate(F.array_compact(F.array(*cols)), F.lit(0.0), lambda a, x: a + x)
    size = lambda cols: F.size(F.array_compact(F.array(*cols)))
    recalls = [F.try_divide(F.col(f"h{c}"), F.col(f"t{c}")) for c in range(classes)]
    f1s = [F.try_divide(2.0 * F.col(f"h{c}"), F.col(f"t{c}") + F.col(f"g{c}")) for c in range(classes)]
    hits = sum((F.col(f"h{c}") for c in range(1, classes)), F.col("h0"))
    top = lambda k: F.greatest(*[F.col(f"{k}{c}") for c in range(classes)]) / n
    return s.select(
        *by, "n", (hits / n).alias("acc"), (add(recalls) / size(recalls)).alias("bal_acc"), (add(f1s) / size(f1s)).alias("f1"),
        (1 - F.try_divide(F.col("__o"), expected)).alias("qwk"), top("t").alias("majority"),
        (top("g") >= 0.90).alias("degenerate"),
    )


def multilabel_metrics(df: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """Macro AUC over the defined labels, AUC of each label, macro F1 and exact-set accuracy; one row."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(y).alias("label"), F.col(y).alias("y"), F.col(p).cast("double").alias("p")) for y, p in labels])
    )
    long = df.select(cells.alias("c")).select("c.*")
    of = lambda y: F.max(F.when(F.col("label") == y, F.col("auc"))).alias(f"auc_{y}")
    auc = roc_auc(long, ["label"], "y", "p").agg(F.avg("auc").alias("auc_macro"), *(of(y) for y, _ in labels))
    hit = lambda y, p: (F.col(y) == 1) & (F.col(p) >= 0.5)
    f1 = None
    exact = F.lit(True)
    for y, p in labels:
        size = F.count_if(F.col(y) == 1) + F.count_if(F.col(p) >= 0.5)
        one = F.coalesce(F.try_divide(2.0 * F.count_if(hit(y, p)), size), F.lit(0.0))
        f1 = one if f1 is None else f1 + one
        exact = exact & ((F.col(y) == 1) == (F.col(p) >= 0.5))
    whole = df.agg(F.count(F.lit(1)).alias("n"), (f1 / len(labels)).alias("f1"), F.avg(exact.cast("double")).alias("acc"))
    one = F.lit(1).alias("__one")
    return whole.select("*", one).join(auc.select("*", one), "__one").drop("__one")


def mean_interval(df: DataFrame, by: Sequence[str], value: str, conf: float = 0.95, single: str = "point") -> DataFrame:
    """Mean with a t interval. ``single`` says what the bounds of one value are: "point" drops
    values that are not finite and repeats the mean, "null" keeps all values and leaves them empty."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    used = F.when(finite, v) if single == "point" else v
    g = df.groupBy(*by).agg(
        F.count(used).alias("n"), F.avg(used).alias("mean"), F.stddev_samp(used).alias("__s")
    )
    q = tails.t_quantile(F.lit((1 + conf) / 2), (F.col("n") - 1).cast("double"))
    half = F.when(F.col("n") > 1, q * F.col("__s") / F.sqrt(F.col("n")))
    if single == "point":
        half = F.coalesce(half, F.when(F.col("n") == 1, F.lit(0.0)))
    return g.select(
        *by, "n", "mean", (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi")
    )


def paired_t(model: DataFrame, base: DataFrame, by: Sequence[str], cell: Sequence[str], value: str) -> DataFrame:
    """Mean difference on matched cells with the paired t test."""
    b = base.select(*by, *cell, F.col(value).alias("__b"))
    d = model.select(*by, *cell, value).join(b, [*by, *cell]).withColumn("__d", F.col(value) - F.col("__b"))
    g = d.groupBy(*by).agg(
        F.count("__d").alias("n"), F.avg("__d").alias("delta_mean"), F.stddev_samp("__d").alias("__s")
    )
    t = F.try_divide(F.col("delta_mean"), F.col("__s") / F.sqrt("n"))
    return g.withColumn("t", t).withColumn(
        "t_p", tails.t_two_sided("t", (F.col("n") - 1).cast("double"))
    ).drop("__s")


def wilcoxon(df: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """Signed-rank test: W+, W-, z, the normal p values and the exact one where it applies."""
    if not by:
        return wilcoxon(df.select(diff, F.lit(1).alias("__all")), ["__all"], diff).drop("__all")
    d = df.where(F.col(diff) != 0).select(
        *by, F.abs(diff).alias("__a"), (F.col(diff) > 0).cast("bigint").alias("__p")
    )
    ranks = mid_ranks(d, by, "__a", ["__p"])
    ties = F.col("n").cast("double")
    g = ranks.groupBy(*by).agg(
        F.max("all_n").alias("n"),
        F.sum(F.col("mid_rank") * F.col("__p")).alias("w_plus"),
        F.sum(F.col("mid_rank") * (F.col("n") - F.col("__p"))).alias("w_minus"),
        F.sum(ties * ties * ties - ties).alias("__tie"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__tie") / 48)
    w = F.least("w_plus", "w_minus")
    out = g.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, sd))
    exact = F.when((F.col("__tie") == 0) & (F.col("n") <= 50), w)
    tested = out.select(
        *by, "n", "w_plus", "w_minus", "z",
        F.least(F.lit(1.0), 2 * tails.normal_upper(F.abs("z"))).alias("p_normal"),
        tails.normal_upper("z").alias("p_greater"),
        tails.signed_rank_exact(exact, n).alias("p_exact"),
    )
    # A group without any difference keeps its row: nothing speaks against equality.
    groups = df.where(F.col(diff).isNotNull()).groupBy(*by).agg(F.bool_and(F.col(diff) == 0).alias("__same"))
    blank = {"n": 0, "w_plus": 0.0, "w_minus": 0.0, "p_normal": 1.0, "p_greater": 1.0, "p_exact": 1.0}
    filled = [F.when(F.col("__same"), F.lit(v)).otherwise(F.col(c)).cast(tested.schema[c].dataType).alias(c) for c, v in blank.items()]
    return groups.join(tested, list(by), "left").select(*by, *filled, "z")


def fisher_greater(df: DataFrame, exposed: Column, case: Column) -> DataFrame:
    """2x2 counts with the sample odds ratio and the one-sided exact p."""
    e, c = F.coalesce(exposed, F.lit(False)), F.coalesce(case, F.lit(False))
    g = df.agg(
        _sum(c & e).alias("a"), _sum(c & ~e).alias("b"), _sum(~c & e).alias("c"), _sum(~c & ~e).alias("d")
    )
    return g.withColumn(
        "odds_ratio", F.try_divide(F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c"))
    ).withColumn("p", tails.fisher_greater("a", "b", "c", "d"))


def binom_greater(df: DataFrame, hit: Column, chance: float) -> DataFrame:
    """Hits against a chance level with the one-sided binomial p."""
    g = df.agg(_sum(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.try_divide(F.col("k"), F.col("n"))).withColumn(
        "p", tails.binom_greater("k", "n", F.lit(chance))
    )


def kruskal(df: DataFrame, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Kruskal-Wallis H over named groups, corrected for ties."""
    kept = df.where(F.col(group).isin(*groups) & F.col(value).isNotNull())
    marks = [(F.col(group) == g).cast("bigint").alias(f"__g{i}") for i, g in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    ranks = mid_ranks(kept.select(value, *marks), [], value, names)
    t = F.col("n").cast("double")
    s = ranks.agg(
        F.max("all_n").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("__tie"),
        *[F.sum(F.col("mid_rank") * F.col(c)).alias(f"r{c}") for c in names],
        *[F.sum(c).alias(f"c{c}") for c in names],
    )
    n = F.col("n")
    parts = [F.coalesce(F.try_divide(F.col(f"r{c}") * F.col(f"r{c}"), F.col(f"c{c}")), F.lit(0.0)) for c in names]
    raw = 12 / (n * (n + 1)) * sum(parts[1:], parts[0]) - 3 * (n + 1)
    used = sum(((F.col(f"c{c}") > 0).cast("int") for c in names[1:]), (F.col(f"c{names[0]}") > 0).cast("int"))
    return s.select(
        n.cast("bigint").alias("n"), used.alias("n_groups"),
        F.try_divide(raw, 1 - F.col("__tie") / (n * n * n - n)).alias("h"),
    ).withColumn("p", tails.chi2_upper("h", (F.col("n_groups") - 1).cast("double")))


def cohen_d(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Standardised mean difference with the pooled deviation; 0 without spread."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(
        F.count(of(a)).alias("na"), F.count(of(b)).alias("nb"), F.avg(of(a)).alias("ma"), F.avg(of(b)).alias("mb"),
        F.var_samp(of(a)).alias("va"), F.var_samp(of(b)).alias("vb"),
    )
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    d = F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled).otherwise(0.0)
    return s.select("na", "nb", d.alias("d"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman and Pearson coefficients. Equal pairs are counted before ranks are joined."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    rx = mid_ranks(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()), [], x).select(x, F.col("mid_rank").alias("rx"), F.col("all_n").alias("total"))
    ry = mid_ranks(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()), [], y).select(y, F.col("mid_rank").alias("ry"))
    j = pairs.join(rx, x).join(ry, y)
    centre = (F.col("total") + 1) / 2.0
    dx, dy, w = F.col("rx") - centre, F.col("ry") - centre, F.col("w")
    spearman = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))
    rho = j.agg(spearman.alias("spearman"))
    return df.agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"),
    ).withColumn("spearman", rho.scalar())


def offset_peak(df: DataFrame, unit: str, pos: str, a: str, b: str, reach: int, chunk: int = 65536) -> DataFrame:
    """Offset with the highest correlation of a(pos) and b(pos + offset), its lead and the value at 0.

    Sequences are cut into chunks that overlap by ``reach``, so a long unit runs in many
    tasks and no row is repeated once per offset.
    """
    own = F.floor(F.col(pos) / chunk)
    inside = F.pmod(F.col(pos), F.lit(chunk))
    homes = F.array_compact(
        F.array(own, F.when(inside < reach, own - 1), F.when(inside >= chunk - reach, own + 1))
    )
    spread = df.select(unit, pos, a, b, F.explode(homes).alias("__c"), own.alias("__own"))
    along = Window.partitionBy(unit, "__c").orderBy(pos)
    offsets = range(-reach, reach + 1)
    at = [F.max(b).over(along.rangeBetween(o, o)).alias(f"b{o + reach}") for o in offsets]
    rows = spread.select(unit, "__c", "__own", a, *at).where(F.col("__c") == F.col("__own"))
    score = lambda o: F.coalesce(
        F.corr(F.when(F.col(f"b{o + reach}").isNotNull(), F.col(a)), F.col(f"b{o + reach}")), F.lit(0.0)
    )
    wide = rows.groupBy(unit).agg(*[F.round(score(o), 9).alias(f"s{o + reach}") for o in offsets])
    cells = F.array(
        *[F.struct(F.lit(o).alias("offset"), F.col(f"s{o + reach}").alias("score")) for o in offsets]
    )
    long = wide.select(unit, F.explode(cells).alias("c")).select(unit, "c.offset", "c.score")
    best = best_and_margin(long, [unit], "score", "offset")
    return best.join(wide.select(unit, F.col(f"s{reach}").alias("score_at_0")), unit)


GRID = [0.05 + 0.025 * i for i in range(37)]


def fit_thresholds(df: DataFrame, by: Sequence[str], z: str, y: str) -> DataFrame:
    """Two thresholds on the grid with the highest accuracy, the first pair on equal accuracy.

    One pass counts the classes per grid cell; the score of a pair is then a sum of two
    prefix counts, so the pairs never meet the data.
    """
    cell = sum(((F.col(z) >= g).cast("int") for g in GRID[1:]), (F.col(z) >= GRID[0]).cast("int"))
    hist = df.groupBy(*by, cell.alias("__c"), y).agg(F.count(F.lit(1)).alias("__n"))
    below = lambda i, c: F.sum(F.when((F.col("__c") <= i) & (F.col(y) == c), F.col("__n")).otherwise(0))
    g = hist.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        F.sum(F.when(F.col(y) == 2, F.col("__n")).otherwise(0)).alias("__top"),
        F.array(*[below(i, 0) - below(i, 1) for i in range(len(GRID))]).alias("__f"),
        F.array(*[below(i, 1) - below(i, 2) for i in range(len(GRID))]).alias("__g"),
    )
    i = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 2))).alias("__i")
    j = F.explode(F.sequence(F.col("__i") + 1, F.lit(len(GRID) - 1))).alias("__j")
    pairs = g.select("*", i).select("*", j)
    score = F.get("__f", F.col("__i")) + F.get("__g", F.col("__j")) + F.col("__top")
    best = F.min_by(F.struct("__i", "__j", score.alias("hits")), F.struct(-score, F.col("__i"), F.col("__j")))
    at = lambda k: F.round(F.lit(0.05) + 0.025 * F.col(f"b.{k}"), 6)
    return pairs.groupBy(*by, "n").agg(best.alias("b")).select(
        *by, "n", at("__i").alias("thr_lo"), at("__j").alias("thr_hi"), (F.col("b.hits") / F.col("n")).alias("accuracy")
    )
