"""Evaluation of predictions: metrics, strata, report-level errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions.scalars import diameter_bucket, size3, size3_rank, zone_of
from cohortine.operators.selection import seeded_sample
from cohortine.operators.statistics import mean_interval


def detection_strata(preds: DataFrame) -> DataFrame:
    """Sensitivity per diameter stratum and specificity, with unit and row counts."""
    stratum = F.when(F.col("y") == 0, "no reported stone").otherwise(
        F.coalesce(diameter_bucket(F.col("max_mm")), F.lit("size not recorded"))
    )
    kind = F.when(F.col("y") == 1, "sensitivity").otherwise("specificity")
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    # rows of one unit meet first, so distinct units need no second pass over the rows
    per_unit = preds.groupBy(stratum.alias("stratum"), kind.alias("kind"), "kidney_id").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(right).alias("__s")
    )
    return per_unit.groupBy("stratum", "kind").agg(
        F.count(F.lit(1)).alias("n_kidneys"),
        F.sum("__n").alias("n_run"),
        (F.sum("__s") / F.sum("__n")).alias("rate"),
    )


def reference_sides(stones: DataFrame, zone: str, cls: str) -> DataFrame:
    """One row per (case, side): the reduced tuple, its zones and its largest known class.

    The reduced tuple has the largest class; on ties the first one in sorted order stays.
    """
    rank = size3_rank(F.col(cls))
    return stones.groupBy("case_id", "side").agg(
        F.min_by(F.struct(F.col(zone).alias("zone"), F.col(cls).alias("cls")), F.struct(-rank, F.col(zone))).alias("ref"),
        F.when(F.min(zone) == F.max(zone), F.min(zone)).alias("single_zone"),
        F.count(F.lit(1)).alias("n_ref_stones"),
    )


def predicted_sides(preds: DataFrame) -> DataFrame:
    """At most one tuple per (seed, case, side); a positive side without size or zone has none.

    The threshold is strict here, unlike in the classification metrics.
    """
    present = F.coalesce(F.col("p") > 0.5, F.lit(False))
    known = present & F.col("zone").isNotNull() & F.col("size_cls").isNotNull()
    return preds.select(
        "seed", "case_id", "side", "has_stone", "max_class",
        present.alias("present"),
        F.when(known, F.struct("zone", F.col("size_cls").alias("cls"))).alias("guess"),
        (present & F.col("size_cls").isNull()).alias("no_size_pred"),
    )


def own_predictions(preds: DataFrame, seen: Column) -> DataFrame:
    """Every (seed, case, side, has_stone) with the prediction of the same seed and side among the rows that are ``seen``.

    A left join of the rows with themselves, inside the few rows of a side, so no row moves for each seed. Rows that repeat
    a key meet all its predictions; null keys meet none.
    """
    guesses = predicted_sides(preds.withColumn("max_class", F.coalesce(seen, F.lit(False)))).withColumnRenamed("max_class", "seen")
    held = guesses.groupBy("case_id", "side").agg(F.collect_list(F.struct("seed", "has_stone", "present", "guess", "seen")).alias("__own"))
    keyed = F.col("case_id").isNotNull() & F.col("side").isNotNull()
    same = F.filter("__own", lambda x: keyed & x["seen"] & (x["seed"] == F.col("u.seed")))
    rows = held.select("case_id", "side", "__own", F.explode("__own").alias("u")).select("case_id", "side", "u", F.explode_outer(same).alias("g"))
    return rows.select("u.seed", "case_id", "side", "u.has_stone", "g.present", "g.guess")


def laterality_of(right: Column, left: Column) -> Column:
    return (
        F.when(right & left, "BILATERAL").when(right, "RIGHT").when(left, "LEFT").otherwise("NONE")
    )


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1, hallucination and omission of summed counts."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    zero = F.lit(0.0)
    return [
        p.alias("precision"), r.alias("recall"), f.alias("f1"),
        F.coalesce(F.try_divide(fp, tp + fp), zero).alias("hallucination"),
        F.coalesce(F.try_divide(fn, tp + fn), zero).alias("omission"),
    ]


def triplet_scores(preds: DataFrame, stones: DataFrame, zone: str, cls: str, seeds: Sequence[int]) -> DataFrame:
    """Micro precision, recall and F1 of (side, zone, class) tuples per seed.

    Scored against all reference tuples and against one reduced tuple per side. Equal
    tuples are counted per case before they meet, so the multiset match is a minimum.
    """
    item = ["case_id", "side", "zone", "cls"]
    # complete and reduced tuples do not depend on the seed: they meet the predictions of all seeds in one row of each tuple
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    mine = lambda s, flag: (flag & (F.col("seed") == s)).cast("bigint")
    none = [zero.alias(f"{c}{i}") for i in range(len(seeds)) for c in "pq"]
    full = stones.select("case_id", "side", F.col(zone).alias("zone"), F.col(cls).alias("cls"), one.alias("n_full"), zero.alias("n_red"), *none)
    reduced = reference_sides(stones, zone, cls).select("case_id", "side", "ref.zone", "ref.cls", zero.alias("n_full"), one.alias("n_red"), *none)
    r = full.unionByName(reduced.dropna(subset=["case_id", "side", "zone"]))
    guessed, unsized = F.col("guess").isNotNull(), F.col("no_size_pred")
    g = predicted_sides(preds).where(guessed | unsized).select(
        "case_id", "side", "guess.zone", "guess.cls", zero.alias("n_full"), zero.alias("n_red"),
        *[mine(s, flag).alias(f"{c}{i}") for i, s in enumerate(seeds) for c, flag in (("p", guessed), ("q", unsized))],
    )
    measures = ["n_full", "n_red", *[f"{c}{i}" for i in range(len(seeds)) for c in "pq"]]
    cells = r.unionByName(g).groupBy(*item).agg(*[F.sum(c).alias(c) for c in measures])
    hits = [F.sum(F.least(f"p{i}", n)).alias(f"t{i}{n}") for i in range(len(seeds)) for n in ("n_full", "n_red")]
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures], *hits)
    rows = [
        F.struct(
            F.lit(s).alias("seed"), F.lit(kind).alias("reference"), F.coalesce(f"t{i}{n}", F.lit(0)).alias("tp"),
            (F.col(f"p{i}") - F.coalesce(f"t{i}{n}", F.lit(0))).alias("fp"), (F.col(n) - F.coalesce(f"t{i}{n}", F.lit(0))).alias("fn"), F.col(f"q{i}").alias("no_size_pred"),
        )
        for i, s in enumerate(seeds) for kind, n in (("complete", "n_full"), ("reduced", "n_red"))
    ]
    sums = total.select(F.inline(F.array(*rows)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("seed", "reference", "tp", "fp", "fn", *precision_recall(tp, fp, fn), "no_size_pred")


def case_sides(units: DataFrame, cases: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(seed, case_id, lat_ref, lat_pred) of every case: laterality in the reference and as predicted. A case without any
    unit is negative on both sides in both."""
    right = F.col("side") == "RIGHT"
    one = lambda s, flag, side: F.bool_or(F.coalesce((F.col("seed") == s) & side & flag, F.lit(False)))
    # the units of a case meet in one row with flags for each seed
    flags = [
        one(s, F.col(flag), side).alias(f"__{flag}{i}{name}")
        for i, s in enumerate(seeds) for flag in ("has_stone", "present") for name, side in (("r", right), ("l", ~right))
    ]
    sided = units.groupBy("case_id").agg(*flags)
    no = F.lit(False)
    lat = lambda i, flag: laterality_of(F.coalesce(f"__{flag}{i}r", no), F.coalesce(f"__{flag}{i}l", no))
    every = F.array(*[F.struct(F.lit(s).alias("seed"), lat(i, "has_stone").alias("lat_ref"), lat(i, "present").alias("lat_pred")) for i, s in enumerate(seeds)])
    return cases.select("case_id").join(sided, "case_id", "left").select("case_id", F.explode(every).alias("e")).select("e.seed", "case_id", "e.lat_ref", "e.lat_pred")


LATERALITIES = ["BILATERAL", "LEFT", "NONE", "RIGHT"]


def laterality_table(preds: DataFrame, stones: DataFrame, zone: str, cls: str, seeds: Sequence[int], cases: DataFrame) -> DataFrame:
    """Cases by laterality in the reference and as predicted, per seed; all sixteen cells, empty ones too."""
    found = case_sides(reference_units(preds, stones, zone, cls, seeds, ("has_stone", "present")), cases, seeds)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("lat_ref"), F.lit(b).alias("lat_pred")) for a in LATERALITIES for b in LATERALITIES])).alias("c")
    counted = found.groupBy("seed", "lat_ref", "lat_pred").agg(F.count(F.lit(1)).alias("n"))
    grid = counted.select("seed").distinct().select("seed", cells).select("seed", "c.*")
    return grid.join(counted, ["seed", "lat_ref", "lat_pred"], "left").na.fill({"n": 0})


def field_scores(preds: DataFrame, stones: DataFrame, zone: str, cls: str, seeds: Sequence[int], cases: DataFrame) -> DataFrame:
    """Laterality, presence, largest class and single-zone accuracy per seed, over every case of ``cases`` and every side of
    the reference; a side that a seed did not predict counts as predicted negative."""
    s = reference_units(preds, stones, zone, cls, seeds, ("has_stone", "present", "guess"))
    agree = (F.col("lat_ref") == F.col("lat_pred")).cast("double")
    lat = case_sides(reference_units(preds, stones, zone, cls, seeds, ("has_stone", "present")), cases, seeds).groupBy("seed").agg(F.avg(agree).alias("laterality_acc"))
    yr, yp = F.col("has_stone"), F.col("present")
    ref_cls = F.col("ref.cls")
    sized, single = yr & ref_cls.isNotNull(), yr & F.col("single_zone").isNotNull()
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    g = s.groupBy("seed").agg(
        F.count_if(yp & yr).alias("tp"), F.count_if(yp & ~yr).alias("fp"), F.count_if(yr & ~yp).alias("fn"),
        F.try_divide(F.count_if(sized & same(F.col("guess.cls"), ref_cls)), F.count_if(sized)).alias("size_cls_acc"),
        F.try_divide(F.count_if(single & same(F.col("guess.zone"), F.col("single_zone"))), F.count_if(single)).alias("zone_acc"),
    )
    p, r, f, _, _ = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select(
        "seed", p.alias("kidney_p"), r.alias("kidney_r"), f.alias("kidney_f1"), "size_cls_acc", "zone_acc"
    ).join(lat, "seed")


CATEGORIES = [
    "exact match", "zone error only", "size error only", "zone + size error", "missed kidney", "detected, not characterized",
    "false-positive kidney", "stone not characterized in reference",
]


PREDICTED = ("has_stone", "max_class", "present", "guess", "no_size_pred")


def reference_units(
    preds: DataFrame, stones: DataFrame, zone: str, cls: str, seeds: Sequence[int], fields: Sequence[str] = PREDICTED
) -> DataFrame:
    """Every (seed, case, side) of the reference with its prediction, and predictions without a reference.

    A side that a seed did not predict counts as predicted negative. ``fields``: what is needed of the predictions; what
    they do not need is not computed.
    """
    # the seeds of a side stand in one row, so the reference meets it once and not once for each seed
    sides, own = predicted_sides(preds), ["seed", *fields]
    held = sides.groupBy("case_id", "side").agg(F.collect_list(F.struct(*own)).alias("__own"))
    refs = reference_sides(stones, zone, cls).select("case_id", "side", "ref", "single_zone", "n_ref_stones")
    listed, kind = F.array(*[F.lit(s) for s in seeds]), dict(held.dtypes)["__own"]
    given = F.coalesce("__own", F.array().cast(kind))
    absent = F.filter(listed, lambda s: F.col("n_ref_stones").isNotNull() & ~F.exists(given, lambda x: x["seed"].eqNullSafe(s)))
    lacking = F.transform(absent, lambda s: F.struct(s.alias("seed"), *[F.lit(None).cast(dict(sides.dtypes)[c]).alias(c) for c in fields]))
    rows = held.join(refs, ["case_id", "side"], "full_outer").select(
        "case_id", "side", "ref", "single_zone", "n_ref_stones", F.explode(F.concat(given, lacking.cast(kind))).alias("x")
    )
    met = F.coalesce(F.col("x.seed").isin(*seeds), F.lit(False))
    known = {c: F.col(f"x.{c}") for c in own}
    for c, unknown in (("present", F.lit(False)), ("no_size_pred", F.lit(False)), ("has_stone", met & F.col("n_ref_stones").isNotNull())):
        if c in known:
            known[c] = F.coalesce(known[c], unknown)
    refs = [F.when(met, F.col(c)).alias(c) for c in ("ref", "single_zone")]
    return rows.select("case_id", "side", *[c.alias(n) for n, c in known.items()], *refs)


def error_categories(preds: DataFrame, stones: DataFrame, zone: str, cls: str, seeds: Sequence[int]) -> DataFrame:
    """Exact partition of the reference tuples of each seed, and the surplus predictions; a row for every category.

    Both sides hold at most one tuple per (case, side), so the match is an equi-join.
    """
    j = reference_units(preds, stones, zone, cls, seeds)
    has_r, has_p = F.col("ref").isNotNull(), F.col("guess").isNotNull()
    zone_bad = ~F.col("guess.zone").eqNullSafe(F.col("ref.zone"))
    size_bad = ~F.col("guess.cls").eqNullSafe(F.col("ref.cls"))
    exact, zone_only, size_only, both, missed, bare, false, surplus = CATEGORIES
    category = (
        F.when(has_r & has_p & ~zone_bad & ~size_bad, exact)
        .when(has_r & has_p & zone_bad & size_bad, both)
        .when(has_r & has_p & zone_bad, zone_only)
        .when(has_r & has_p, size_only)
        .when(has_r & ~F.col("present"), missed)
        .when(has_r, bare)
        .when(has_p & ~F.col("has_stone"), false)
        .when(has_p, surplus)
    )
    counts = j.select("seed", category.alias("c"), has_r.alias("r")).groupBy("seed").agg(
        F.array(*[F.struct(F.lit(c).alias("category"), F.count_if(F.col("c") == c).alias("n")) for c in CATEGORIES]).alias("k"),
        F.count_if("r").alias("r"),
    )
    return counts.select("seed", F.explode("k").alias("k"), "r").select("seed", "k.category", "k.n", F.try_divide(F.col("k.n"), F.col("r")).alias("share"))


def persistent_errors(preds: DataFrame, limit: float = 0.2) -> DataFrame:
    """Units that are right in at most ``limit`` of their runs, and how they fail."""
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    g = preds.groupBy("kidney_id").agg(
        F.max("y").alias("y"), F.avg(right).alias("correct"), F.max("max_mm").alias("max_mm"),
        F.bool_and("mask_plausible").alias("mask_plausible"),
    )
    failure = F.when(F.col("y") == 1, "missed stone").otherwise("false alarm")
    return g.where(F.col("correct") <= limit).withColumn("failure", failure)


def pooled_rates(preds: DataFrame) -> DataFrame:
    """Accuracy and error rates over all rows of all runs."""
    hit, pos = F.col("p") >= 0.5, F.col("y") == 1
    rate = lambda rule: F.avg(rule.cast("double"))
    return preds.agg(
        F.count(F.lit(1)).alias("n_pooled"), rate(hit == pos).alias("acc"),
        rate(pos & ~hit).alias("fn_rate"), rate(~pos & hit).alias("fp_rate"),
    )


def steady_mean(value: str) -> Column:
    """The mean of values of about one, the same in any order of the rows.

    The leading 26 binary places and the rest are added apart, each without rounding, so only the two totals round.
    """
    head = F.rint(F.col(value) * 2.0**26) / 2.0**26
    return F.try_divide(F.sum(head) + F.sum(F.col(value) - head), F.count(value))


def averaged_thresholds(rows: DataFrame, runs: DataFrame, by: Sequence[str], z: str, each: Sequence[str] = ()) -> DataFrame:
    """Zone of each row by the thresholds of its run group, averaged over the folds; once for each value of ``each``.

    One row of means for each run group goes to every task. Left to itself, the planner may broadcast the rows instead, whose
    estimate is the size of the columns read, before they are repeated by side and seed. The means do not depend on the order of
    the folds, as a row whose position is a mean would change its zone with it.
    """
    means = runs.groupBy(*by, *each).agg(steady_mean("thr_lo").alias("t1"), steady_mean("thr_hi").alias("t2"))
    return rows.join(F.broadcast(means), list(by)).withColumn("zone", zone_of(F.col(z), F.col("t1"), F.col("t2"))).drop("t1", "t2")


def config_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str], full: int) -> DataFrame:
    """Mean and interval of every metric per configuration, in long form, with run counts.

    Null cells are skipped; null group keys stay a group.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    )
    long = runs.select(*by, cells.alias("c")).select(*by, "c.metric", "c.v")
    out = mean_interval(long, [*by, "metric"], "v").where("n > 0")
    sizes = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("degenerate").alias("degenerate_runs"))
    keyed = [out[k].eqNullSafe(sizes[k]) for k in by]
    on = keyed[0]
    for k in keyed[1:]:
        on = on & k
    return out.join(sizes, on).select(
        *[out[k] for k in by], "metric", "n", "mean", "ci_lo", "ci_hi", "n_runs",
        (F.col("n_runs") < full).alias("incomplete"), "degenerate_runs",
    )


def selected_versus_random(rows: DataFrame, by: str, chosen: Column, key: str, value: str, n: int, seed: int) -> DataFrame:
    """Per unit: mean of the chosen rows and of a seeded sample of the others."""
    marked = rows.withColumn("__chosen", F.coalesce(chosen, F.lit(False)))
    picks = marked.where("__chosen").groupBy(by).agg(F.count(F.lit(1)).alias("n_selected"), F.avg(value).alias("sel_mean"))
    others = seeded_sample(marked.where(~F.col("__chosen")), by, key, n, seed)
    rest = others.groupBy(by).agg(F.avg(value).alias("rnd_mean"))
    return picks.join(rest, by).withColumn("diff", F.col("sel_mean") - F.col("rnd_mean"))


def index_hypotheses(units: DataFrame, index: str, sizes: dict[str, str], unit: str) -> DataFrame:
    """Share of units whose indices all fit under each candidate size, and the surviving meaning."""
    fits = units.groupBy(unit).agg(
        *[F.bool_and((F.col(size) > 0) & (F.col(index) < F.col(size))).alias(name) for name, size in sizes.items()]
    )
    names = list(sizes)
    g = fits.agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.avg(F.col(n).cast("double")).alias(f"{n}_share") for n in names],
        F.bool_and(names[0]).alias("__all"),
    )
    h2, h3 = F.col(f"{names[1]}_share") > 0.5, F.col(f"{names[2]}_share") > 0.5
    winner = F.when(F.col("__all") & ~h2 & ~h3, names[0]).when(h2, names[1]).otherwise("UNRESOLVED")
    return g.withColumn("winner", winner).drop("__all")
