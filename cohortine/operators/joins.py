"""Joins: outer bridges, presence audits, nearest and within-distance matches, remaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortine.operators.ordering import ROWS_PER_CELL, cut, number_rows, splits


def outer_bridge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with the origin of each row."""
    l, r = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    origin = (
        F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    )
    return l.join(r, list(keys), "full_outer").withColumn("origin", origin).drop("__l", "__r")


def presence_audit(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a flag for every source; one shuffle for any number of sources."""
    union = None
    for name, df in sources.items():
        flags = [F.lit(other == name).alias(other) for other in sources]
        part = df.select(key, *flags)
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(*[F.bool_or(name).alias(name) for name in sources])


def split_by_membership(df: DataFrame, members: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Rows marked by whether their key occurs in another table; a null key does not."""
    keys = members.select(key).distinct().withColumn("__in", F.lit(True))
    group = F.when(F.col("__in"), names[0]).otherwise(names[1])
    return df.join(keys, key, "left").withColumn("group", group).drop("__in").select(*df.columns, "group")


def pair_by_order(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    lead: Column,
    keep: Sequence[str],
) -> DataFrame:
    """k-th row of one table with the k-th row of the other, as structs ``left`` and ``right``."""
    cols = [F.col(c) for c in order]
    l = number_rows(left, by, cols, lead, "k").select(*by, "k", F.struct(*keep).alias("left"))
    r = number_rows(right, by, cols, lead, "k").select(*by, "k", F.struct(*keep).alias("right"))
    return l.join(r, [*by, "k"])


def near_any(
    points: DataFrame, targets: DataFrame, by: Sequence[str], point: str, target: str, reach: float
) -> DataFrame:
    """Flag ``near``: some target of the group lies within ``reach`` of the point.

    A bucket of width ``reach`` needs only its smallest and largest target: a target in
    the same bucket is always near, the neighbours are near by their inner end.
    """
    keys = list(by)
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("bigint")
    ends = targets.groupBy(*keys, bucket(target).alias("__b")).agg(
        F.min(target).alias("__min"), F.max(target).alias("__max")
    )
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("__step")
    spread = (
        ends.select(*keys, "__b", "__min", "__max", step)
        .withColumn("__b", F.col("__b") + F.col("__step"))
        .groupBy(*keys, "__b")
        .agg(
            F.bool_or(F.col("__step") == 0).alias("__same"),
            F.max(F.when(F.col("__step") == 1, F.col("__max"))).alias("__below"),
            F.min(F.when(F.col("__step") == -1, F.col("__min"))).alias("__above"),
        )
    )
    y = F.col(point)
    near = (
        F.coalesce("__same", F.lit(False))
        | F.coalesce(y - F.col("__below") <= reach, F.lit(False))
        | F.coalesce(F.col("__above") - y <= reach, F.lit(False))
    )
    return (
        points.withColumn("__b", bucket(point))
        .join(spread, [*keys, "__b"], "left")
        .withColumn("near", near)
        .drop("__b", "__same", "__below", "__above")
    )


def nearest_join(
    points: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    point: str,
    target: str,
    name: str = "nearest",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Position of the closest target of the group; the lower one on equal distance.

    Both tables are merged along the axis and each point looks at the last target before
    it and the first one after it, so no pairs are formed. Large groups are cut into cells.
    """
    keys = list(by)
    kept = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.col(point).alias("__x"), F.struct(*kept).alias("__row"))
    t = targets.select(*keys, F.col(target).alias("__x"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"))
    both = p.withColumn("__t", F.lit(False)).unionByName(t.withColumn("__t", F.lit(True)))
    points_at = splits(both, keys, F.col("__x"), rows_per_cell)
    here = F.when(F.col("__t"), F.col("__x"))
    # Both frames grow row by row; a frame that ends with the group would be read anew for every row.
    cell = Window.partitionBy(*keys, "__cell")
    back = cell.orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = cell.orderBy(F.col("__x").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("__cell")
    borders = (
        cut(both, keys, F.col("__x"), points_at, large=True)
        .groupBy(*keys, "__cell")
        .agg(F.max(here).alias("__top"), F.min(here).alias("__bottom"))
        .withColumn("__p", F.max("__top").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("__q", F.min("__bottom").over(across.rowsBetween(1, Window.unboundedFollowing)))
        .drop("__top", "__bottom")
    )
    seen = (
        cut(both, keys, F.col("__x"), points_at)
        .withColumn("__before", F.max(here).over(back))
        .withColumn("__after", F.min(here).over(ahead))
        .where(~F.col("__t"))
        .join(borders, [*keys, "__cell"], "left")
    )
    lower = F.coalesce("__before", "__p")
    upper = F.coalesce("__after", "__q")
    x = F.col("__x")
    closest = (
        F.when(lower.isNull(), upper)
        .when(upper.isNull(), lower)
        .when(x - lower <= upper - x, lower)
        .otherwise(upper)
    )
    return seen.select(*keys, "__row.*", closest.alias(name))


def interpolate(
    points: DataFrame, values: DataFrame, by: Sequence[str], x: str, index: str, value: str
) -> DataFrame:
    """Linear interpolation of a fractional index into indexed values, clamped at the ends."""
    keys = list(by)
    ends = values.groupBy(*keys).agg(F.min(index).alias("__first"), F.max(index).alias("__last"))
    inside = F.greatest(
        F.least(F.col(x).cast("double"), F.col("__last").cast("double")), F.col("__first").cast("double")
    )
    p = points.join(ends, keys).withColumn("__x", inside).drop("__first", "__last")
    p = p.withColumn("__i", F.floor("__x")).withColumn("__j", F.ceil("__x"))
    low = values.select(*keys, F.col(index).alias("__i"), F.col(value).alias("__a"))
    high = values.select(*keys, F.col(index).alias("__j"), F.col(value).alias("__c"))
    weight = F.col("__x") - F.col("__i")
    return (
        p.join(low, [*keys, "__i"], "left")
        .join(high, [*keys, "__j"], "left")
        .withColumn("interpolated", F.col("__a") + (F.col("__c") - F.col("__a")) * weight)
        .drop("__x", "__i", "__j", "__a", "__c")
    )


def thirds_band(x: Column, lo: Column, hi: Column) -> Column:
    """Third of an extent that holds a point; equal bands need no range join."""
    share = F.try_divide(x - lo, hi - lo)
    return F.when(share >= 2 / 3, "UPPER").when(share >= 1 / 3, "MID").when(share.isNotNull(), "LOWER")


def rank_match(
    candidates: DataFrame, stones: DataFrame, selected: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Candidates matched to findings by size rank inside (case, side), with evidence.

    ``candidates``: case_id, side, candidate_id, volume, y_row, diameter. ``stones``:
    case_id, side, stone_index, size_mm and the ``order`` columns. ``selected``: case_id, row.
    """
    by = ["case_id", "side"]
    marked = near_any(candidates, selected, ["case_id"], "y_row", "row", 10)
    c = number_rows(marked, by, [F.col("volume").desc(), F.col("candidate_id")], -F.col("volume"), "rank")
    size = F.coalesce(F.col("size_mm"), F.lit(-1.0))
    s = number_rows(
        stones, by, [F.col("size_mm").desc_nulls_last(), *[F.col(o) for o in order]], -size, "rank"
    ).select(*by, "rank", "stone_index", "size_mm")
    consistent = F.coalesce(F.col("diameter") >= 0.4 * F.col("size_mm"), F.lit(False))
    evidence = F.array_compact(
        F.array(
            F.lit("side"),
            F.concat(F.lit("size_rank_"), F.col("rank").cast("string")),
            F.when(F.col("near"), "row_within_10px"),
            F.when(consistent, "size_consistent"),
        )
    )
    confidence = 0.6 + F.when(F.col("near"), 0.2).otherwise(0.0) + F.when(consistent, 0.2).otherwise(0.0)
    matched = F.col("stone_index").isNotNull()
    return c.join(s, [*by, "rank"], "left").select(
        *by,
        "candidate_id",
        "stone_index",
        F.when(matched, F.round(confidence, 2)).alias("match_confidence"),
        F.when(matched, evidence).otherwise(F.array().cast("array<string>")).alias("match_evidence"),
    )


def remap_index(df: DataFrame, j: str, old: tuple[str, str], new: tuple[str, str], size: int) -> DataFrame:
    """Index in one frame to index in another through the physical axis."""
    y = F.col(old[0]) + F.col(j) * F.col(old[1])
    moved = (y - F.col(new[0])) / F.col(new[1])
    inside = (moved >= 0) & (moved < size)
    return df.select(
        "*",
        y.alias("y_mm"),
        moved.alias("j_new"),
        inside.alias("inside"),
        F.when(inside, F.bround(moved, 0).cast("int")).alias("j_row"),
        ((F.abs(F.col(old[1]) - F.col(new[1])) < 1e-6) & (F.abs(F.col(old[0]) - F.col(new[0])) < 1e-6)).alias(
            "same_frame"
        ),
    )
