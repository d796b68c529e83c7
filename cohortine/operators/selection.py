"""Choosing rows: best per key, roles, samples, numbering and pseudonyms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.operators.facts import leading
from cohortine.operators.ordering import hash_positions, number_rows


def keep_largest(df: DataFrame, key: str, size: str, tie: str) -> DataFrame:
    """One row per key: the largest, then the first by ``tie``. An aggregate, not a window."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(size), F.col(tie)))
    return df.groupBy(key).agg(best.alias("__r"), F.count(F.lit(1)).alias("n_copies")).select(
        key, "__r.*", "n_copies"
    )


def select_roles(series: DataFrame) -> DataFrame:
    """Series per role with ordered fallbacks; one aggregate per case finds all roles.

    ``series``: case_id, series_id, plane, thickness, is_original, n_slices.
    """
    axial = F.col("plane") == "AXIAL"
    thin = axial & (F.col("thickness") <= V.THIN_MAX)
    tier = (
        F.when(F.col("thickness").between(*V.STANDARD_BAND), 0)
        .when(F.col("thickness") <= V.THIN_MAX, 1)
        .otherwise(2)
    )
    rank = [(~F.col("is_original")).alias("a"), (-F.col("n_slices")).alias("b"), F.col("series_id").alias("c")]

    def best(rule: Column, value: Column, *front: Column) -> Column:
        return F.min_by(value, F.when(rule, F.struct(*front, *rank)))

    sid = F.col("series_id")
    found = series.groupBy("case_id").agg(
        best(axial, F.struct(sid.alias("id"), tier.alias("tier")), tier.alias("t")).alias("main"),
        best(thin, sid).alias("thin"),
        best(F.col("plane") == "CORONAL", sid).alias("coronal"),
        best(F.col("plane") == "SAGITTAL", sid).alias("sagittal"),
    )
    reasons = [
        "2.0-3.5mm axial, ORIGINAL preferred, most slices",
        "fallback: thin axial (no 2.5mm series)",
        "fallback: any axial",
    ]
    why = F.get(F.array(*[F.lit(r) for r in reasons]), F.col("main.tier"))

    def role(name: str, rule: Column, chosen: Column, reason: Column) -> Column:
        return F.when(
            rule, F.struct(F.lit(name).alias("role"), chosen.alias("series_id"), reason.alias("selection_reason"))
        )

    roles = F.array_compact(
        F.array(
            role("axial_std", F.col("main").isNotNull(), F.col("main.id"), why),
            role(
                "axial_thin",
                F.col("thin").isNotNull() & ~F.col("thin").eqNullSafe(F.col("main.id")),
                F.col("thin"),
                F.lit("<=1.25mm axial, most slices"),
            ),
            role("coronal_native", F.col("coronal").isNotNull(), F.col("coronal"), F.lit("coronal reformat with most slices")),
            role("sagittal_native", F.col("sagittal").isNotNull(), F.col("sagittal"), F.lit("sagittal reformat with most slices")),
        )
    )
    return found.select("case_id", F.inline(roles))


def resolve_studies(studies: DataFrame, rules: DataFrame) -> DataFrame:
    """One examination per patient, by a named collection or by the largest axial series.

    ``studies``: patient_id, study, study_date, collection, n_slices. ``rules``: patient_id,
    wanted (collection), verified. A patient with one study needs no rule.
    """
    j = studies.join(rules, "patient_id", "left")
    wanted = F.coalesce(F.col("collection").contains(F.col("wanted")), F.lit(False))
    by_rule = F.struct(~wanted, F.col("study_date"), F.col("study"))
    by_size = F.struct(-F.col("n_slices"), F.col("study_date"), F.col("study"))
    row = F.struct("study", "study_date", "collection")
    g = j.groupBy("patient_id").agg(
        (F.min("study") == F.max("study")).alias("single"),
        F.max("wanted").alias("rule"),
        F.bool_or("verified").alias("ok"),
        F.min_by(row, by_rule).alias("ruled"),
        F.min_by(row, by_size).alias("sized"),
    )
    how = (
        F.when(F.col("single"), "SINGLE_STUDY")
        .when(F.col("rule").isNotNull(), "PREFER_COLLECTION")
        .otherwise("PREFER_LARGEST_AXIAL")
    )
    pick = F.when(~F.col("single") & F.col("rule").isNotNull(), F.col("ruled")).otherwise(F.col("sized"))
    return g.select(
        "patient_id",
        pick.alias("p"),
        how.alias("study_assignment"),
        (F.col("single") | F.coalesce("ok", F.lit(False))).alias("verified"),
    ).select("patient_id", "p.*", "study_assignment", "verified")


def first_exam(cases: DataFrame) -> DataFrame:
    """Marks the earliest examination of each patient; the id decides on equal dates."""
    first = cases.groupBy("patient_id").agg(
        F.min_by("case_id", F.struct("study_date", "case_id")).alias("__first")
    )
    return cases.join(first, "patient_id").withColumn("primary_exam", F.col("case_id") == F.col("__first")).drop("__first")


def representative(df: DataFrame, by: str, size: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Values of the largest row per group; each value skips its own nulls, unknown sizes last."""
    rank = leading(F.col(size), [F.col(tie)])
    picks = [F.min_by(v, F.when(F.col(v).isNotNull(), rank)).alias(v) for v in values]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_cases"), *picks)


def normal_positions(df: DataFrame, by: str, order: Sequence[str], lead: Column) -> DataFrame:
    """Zero-based index after sorting and its share of the range; 0.5 for a single row."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    numbered = number_rows(df, [by], [F.col(c) for c in order], lead, "__k").join(counts, by)
    share = F.when(F.col("n") <= 1, 0.5).otherwise((F.col("__k") - 1) / F.nullif(F.col("n") - 1, F.lit(0)))
    return numbered.withColumn("index", F.col("__k") - 1).withColumn("position", share).drop("__k")


def stratified_positions(df: DataFrame, by: str, index: str, k: int, seed: int) -> DataFrame:
    """``k`` positions per bag: one seeded draw per equal segment, or even coverage of a short bag."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), F.col(index).cast("string")), 256)
    segment = F.floor(((F.col(index) + 1) * k - 1) / F.col("n")).cast("int")
    long = (
        df.join(sizes.where(F.col("n") > k), by)
        .groupBy(by, segment.alias("slot"))
        .agg(F.min_by(index, draw).alias("pos"))
    )
    even = F.bround(F.col("slot") * (F.col("n") - 1) / F.lit(float(max(k - 1, 1))), 0)
    short = (
        sizes.where(F.col("n") <= k)
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .select(by, "slot", even.cast("bigint").alias("pos"))
    )
    return long.select(by, "slot", F.col("pos").cast("bigint").alias("pos")).unionByName(short)


def pseudonyms(df: DataFrame, key: str, cohort: str, salt: str, prefixes: dict[str, str]) -> DataFrame:
    """Sequential ids in the order of a salted hash, with one prefix per cohort."""
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    numbered = hash_positions(df.withColumn("__h", digest), [cohort], "__h", "__rn")
    prefix = F.coalesce(*[F.when(F.col(cohort) == c, p) for c, p in prefixes.items()])
    number = F.col("__rn").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.withColumn("patient_id", F.concat(prefix, padded)).drop("__h", "__rn")


def best_and_margin(df: DataFrame, by: Sequence[str], score: str, item: str) -> DataFrame:
    """Best item, its score and its lead over the runner-up, with two aggregates."""
    keys = list(by)
    dense = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("__n"), F.min(item).alias("__i")
    )
    top = dense.groupBy(*keys).agg(F.max(F.struct(score, "__n", "__i")).alias("__t"))
    second = (
        dense.join(top, keys)
        .where(F.col(score) < F.col(f"__t.{score}"))
        .groupBy(*keys)
        .agg(F.max(score).alias("__s"))
    )
    runner = F.when(F.col("__t.__n") > 1, F.col(f"__t.{score}")).otherwise(F.col("__s"))
    return top.join(second, keys, "left").select(
        *keys,
        F.col("__t.__i").alias("best_item"),
        F.col(f"__t.{score}").alias("best_score"),
        (F.col(f"__t.{score}") - runner).alias("margin"),
    )


def argmax_share(df: DataFrame, by: Sequence[str], pos: str, score: str) -> DataFrame:
    """Position of the first largest score as a share of the sequence."""
    peak = F.max_by(pos, F.struct(F.col(score), -F.col(pos)))
    return df.groupBy(*by).agg(
        (peak / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("z_hat"), F.count(F.lit(1)).alias("n")
    )


def letter_suffix(cases: DataFrame, order: Sequence[str], lead: Column, by: Sequence[str] = ()) -> DataFrame:
    """A and B for the two examinations of a patient (in each group ``by``); other patients keep their id."""
    keys = [*by, "patient_id"]
    counts = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    two = cases.join(counts, keys)
    pairs = number_rows(two.where("__n = 2"), keys, [F.col(c) for c in order], lead, "__k")
    base = F.col("patient_id").cast("string")
    a = pairs.withColumn("sub_id", F.concat(base, F.lit("_"), F.char(F.col("__k") + 64))).drop("__k", "__n")
    return a.unionByName(two.where("__n <> 2").withColumn("sub_id", base).drop("__n"))


def best_per_class(df: DataFrame, cls: str, prefer: Column, size: str, item: str) -> DataFrame:
    """One item per class: those that satisfy the preference first, then the largest."""
    rank = F.struct(~F.coalesce(prefer, F.lit(False)), -F.col(size), F.col(item))
    return df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.min_by(F.struct(item, size), rank).alias("__b")).select(
        cls, "__b.*"
    )


def frequent_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def scenario_picks(df: DataFrame, item: str, scenarios: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Best item per scenario, never the same item twice; a taken or empty scenario gets the next item.

    Every scenario is a name, a condition and a size to maximise. The best items come from
    one aggregate; the choice without reuse is made on that single row.
    """
    n = len(scenarios)
    picks = [
        F.min_by(item, F.when(rule, F.struct(-size.cast("double"), F.col(item)))).alias(f"p{i}")
        for i, (_, rule, size) in enumerate(scenarios)
    ]
    spare = df.select(item).distinct().orderBy(item).limit(2 * n).agg(
        F.sort_array(F.collect_list(item)).alias("spare")
    )
    row = df.agg(*picks).withColumn("spare", spare.scalar())
    kind = df.schema[item].dataType.simpleString()
    row = row.withColumn("used", F.array().cast(f"array<{kind}>"))
    for i in range(n):
        mine = F.col(f"p{i}")
        free = mine.isNotNull() & ~F.array_contains(F.col("used"), F.coalesce(mine, F.get("spare", F.lit(0))))
        fallback = F.get(F.array_except("spare", "used"), F.lit(0))
        row = (
            row.withColumn(f"n{i}", ~free)
            .withColumn(f"c{i}", F.when(free, mine).otherwise(fallback))
            .withColumn("used", F.when(F.col(f"c{i}").isNotNull(), F.array_append("used", F.col(f"c{i}"))).otherwise(F.col("used")))
        )
    out = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("scenario"),
                F.lit(name).alias("label"),
                F.col(f"c{i}").alias(item),
                F.col(f"n{i}").alias("nearest_available"),
            )
            for i, (name, _, _) in enumerate(scenarios)
        ]
    )
    return row.select(F.inline(out)).where(F.col(item).isNotNull())


def seeded_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per group in the order of a seeded hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    numbered = hash_positions(df.withColumn("__h", digest), [by], "__h", "draw")
    return numbered.where(F.col("draw") <= n).drop("__h")
