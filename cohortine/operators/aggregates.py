"""Group summaries. Everything has a partial form, so hot groups shrink before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.functions.scalars import size_class, window8
from cohortine.operators.ordering import group_medians, group_modes, ordered_gaps


def joined_set(c: Column | str) -> Column:
    """Sorted distinct values of a small vocabulary, joined by a pipe."""
    return F.array_join(F.sort_array(F.collect_set(c)), "|")


def group_inventory(
    facts: DataFrame, groups: DataFrame, key: str, unique: str, series: str, lists: Sequence[str]
) -> DataFrame:
    """Rows, distinct ids, distinct series and value lists; groups without facts stay visible."""
    summed = facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct(unique).alias("n_unique"),
        F.countDistinct(series).alias("n_series"),
        *[joined_set(c).alias(c) for c in lists],
    )
    counts = {c: 0 for c in ("n_files", "n_unique", "n_series")}
    return groups.select(key).distinct().join(summed, key, "left").na.fill({**counts, **{c: "" for c in lists}})


def merge_lists(df: DataFrame, key: str, joined: str) -> DataFrame:
    """Pipe-joined lists of many rows to one distinct sorted list per key."""
    items = df.select(key, F.explode(F.split(joined, r"\|")).alias("__v")).where("__v <> ''").distinct()
    return items.groupBy(key).agg(joined_set("__v").alias(joined))


def gap_stats(df: DataFrame, by: str, position: str) -> DataFrame:
    """Extent, median, spread and maximum of the gaps along a sorted axis."""
    gaps = ordered_gaps(df, [by], position)
    spread = gaps.groupBy(by).agg(
        F.stddev_pop("gap").alias("gap_std"), F.max("gap").alias("max_gap")
    )
    ends = df.groupBy(by).agg(
        F.count(position).alias("n"),
        (F.max(position) - F.min(position)).alias("extent"),
        (F.count(position) - F.countDistinct(F.round(position, 3))).alias("n_duplicates"),
    )
    median = group_medians(gaps, [by], "gap", "median_gap")
    return (
        ends.join(spread, by, "left")
        .join(median, by, "left")
        .withColumn("irregular", F.coalesce(F.col("gap_std") > 0.01, F.lit(False)))
        .withColumn("has_gap", F.coalesce(F.col("max_gap") > 2 * F.col("median_gap"), F.lit(False)))
    )


def series_summary(df: DataFrame, by: str, value: str, label: str, first: str, order: str) -> DataFrame:
    """Rows, median, most frequent label, first label and the list of labels of a series."""
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct(order).alias("n_slices"),
        F.min_by(first, order).alias("first_label"),
        joined_set(label).alias("labels"),
    )
    return base.join(group_medians(df, [by], value, "median_value"), by, "left").join(
        group_modes(df, [by], label, "mode_label"), by, "left"
    )


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts and row shares of a cross table, in long form."""
    counts = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(truth))
    return counts.withColumn("row_share", F.col("n") / whole)


def case_rollup(stones: DataFrame, mm: str) -> DataFrame:
    """Largest, smallest and total size per case, with the class of the largest."""
    out = stones.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_stones"),
        F.max(mm).alias("max_mm"),
        F.min(mm).alias("min_mm"),
        F.bround(F.sum(mm), 1).alias("sum_mm"),
    )
    return out.withColumn("max_class", size_class(F.col("max_mm")))


def mean_vector_argmax(df: DataFrame, unit: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a unit and its first largest position."""
    means = (
        df.select(unit, F.posexplode(vector).alias("pos", "__p"))
        .groupBy(unit, "pos")
        .agg(F.avg("__p").alias("__m"))
    )
    return means.groupBy(unit).agg(
        F.max_by("pos", F.struct(F.col("__m"), -F.col("pos"))).alias("argmax"),
        F.max("__m").alias("top"),
    )


def saturation(voxels: DataFrame, hu: str) -> DataFrame:
    """Share of saturated voxels per window, among dense voxels and in the body."""
    x = F.col(hu)
    dense, body = x >= 200, x > -500
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(w).alias("window"), (window8(x, *V.WINDOWS[w]) == 255).alias("full"))
                for w in V.WINDOW_ORDER
            ]
        )
    )
    rows = voxels.select(dense.alias("dense"), body.alias("body"), cells.alias("c"))
    share = lambda rule: F.try_divide(F.count_if(F.col("c.full") & rule), F.count_if(rule))
    return rows.groupBy("c.window").agg(
        share(F.col("dense")).alias("stone_voxel_saturation"), share(F.col("body")).alias("body_saturation")
    )


def point_geometry(
    points: DataFrame, by: Sequence[str], row: str, col: str, z: str, spacing: tuple[float, float, float]
) -> DataFrame:
    """Half-open bounding box, centroid, volume and thirds of a set of grid points."""
    volume = F.count(F.lit(1)) * float(spacing[0] * spacing[1] * spacing[2])
    g = points.groupBy(*by).agg(
        F.min(row).alias("r0"), (F.max(row) + 1).alias("r1"),
        F.min(col).alias("c0"), (F.max(col) + 1).alias("c1"),
        F.min(z).alias("s0"), (F.max(z) + 1).alias("s1"),
        F.round(F.avg(row), 1).alias("centroid_r"),
        F.round(F.avg(col), 1).alias("centroid_c"),
        F.round(F.avg(z), 1).alias("centroid_s"),
        F.round(volume, 1).alias("volume_mm3"),
    )
    lo, hi = F.col("s0") * float(spacing[2]), (F.col("s1") - 1) * float(spacing[2])
    third = (hi - lo) / 3.0
    return (
        g.withColumn("z_extent_mm", F.round(hi - lo, 1))
        .withColumn("lower_end_mm", F.round(lo + third, 2))
        .withColumn("mid_end_mm", F.round(lo + 2 * third, 2))
    )


def lse_pool(df: DataFrame, by: Sequence[str], logit: str, r: float = 4.0) -> DataFrame:
    """Length-normalised log-sum-exp over a bag, shifted by the largest logit."""
    keys = list(by)
    z = F.col(logit) * r
    top = df.groupBy(*keys).agg(F.max(z).alias("__m"))
    return (
        df.join(top, keys)
        .groupBy(*keys, "__m")
        .agg(F.sum(F.exp(z - F.col("__m"))).alias("__s"), F.count(F.lit(1)).alias("n"))
        .select(*keys, "n", ((F.col("__m") + F.log("__s") - F.log(F.col("n").cast("double"))) / r).alias("pooled"))
    )


def rate_by_class(df: DataFrame, cls: str, hit: str, order: Sequence[str]) -> DataFrame:
    """Hits and totals per class, numbered in the fixed class order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(cls))
    return (
        df.where(F.col(cls).isNotNull())
        .groupBy(cls)
        .agg(F.count_if(F.col(hit)).alias("n_hit"), F.count(F.lit(1)).alias("n"))
        .withColumn("rate", F.col("n_hit") / F.col("n"))
        .withColumn("rank", rank.cast("int"))
    )
