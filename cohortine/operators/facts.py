"""Case, side and finding tables: rollups, melts and nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions.labels import parse_zone_cell
from cohortine.functions.scalars import size_class

FAR = 1.0e300


def leading(value: Column, order: Sequence[Column]) -> Column:
    """Sort struct: larger known values first, unknown values last, then the given order."""
    first = F.coalesce(-value.cast("double"), F.lit(FAR)).alias("k0")
    return F.struct(first, *[o.alias(f"k{i}") for i, o in enumerate(order, 1)])


def zone_flags(zone: Column) -> tuple[Column, Column, Column]:
    """Upper, mid and lower membership of a possibly compound zone."""
    return (
        zone.isin("UPPER", "MID_UPPER"),
        zone.isin("MID", "MID_UPPER", "MID_LOWER"),
        zone.isin("LOWER", "MID_LOWER"),
    )


def side_rollup(stones: DataFrame, zone: str, mm: str, order: Sequence[str]) -> DataFrame:
    """One row per (case, side) with findings; every aggregate has a partial form."""
    upper, mid, lower = zone_flags(F.col(zone))
    rank = leading(F.col(mm), [F.col(c) for c in order])
    return stones.groupBy("case_id", "side").agg(
        F.count(F.lit(1)).alias("n_characterized"),
        F.max(mm).alias("max_mm"),
        F.bool_or(upper).alias("zone_upper"),
        F.bool_or(mid).alias("zone_mid"),
        F.bool_or(lower).alias("zone_lower"),
        F.min_by(zone, rank).alias("dominant_zone"),
    )


def side_rows(cases: DataFrame) -> DataFrame:
    """Two rows per case."""
    return cases.withColumn("side", F.explode(F.array(F.lit("RIGHT"), F.lit("LEFT"))))


def kidney_table(
    cases: DataFrame, stones: DataFrame, zone: str, mm: str, order: Sequence[str]
) -> DataFrame:
    """One row per (case, side); sides without findings stay visible."""
    rolled = side_rollup(stones, zone, mm, order)
    no = F.lit(False)
    return (
        side_rows(cases)
        .join(rolled, ["case_id", "side"], "left")
        .withColumn("has_stone", F.col("n_characterized").isNotNull())
        .withColumn("n_characterized", F.coalesce("n_characterized", F.lit(0)))
        .withColumn("max_class", size_class(F.col("max_mm")))
        .withColumn("zone_upper", F.coalesce("zone_upper", no))
        .withColumn("zone_mid", F.coalesce("zone_mid", no))
        .withColumn("zone_lower", F.coalesce("zone_lower", no))
        .withColumn("dominant_zone", F.coalesce("dominant_zone", F.lit("UNKNOWN")))
    )


def wide_to_stones(wide: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs of (zone cell, size) columns to numbered rows; anomaly cells are not findings."""
    cells = F.array(
        *[
            F.struct(
                F.lit(z).alias("source_column"),
                F.trim(z).alias("zone_raw"),
                F.col(m).alias("size_mm"),
                parse_zone_cell(F.col(z)).alias("cell"),
            )
            for z, m in pairs
        ]
    )
    kept = F.filter(
        cells,
        lambda c: (c["zone_raw"].isNotNull() | c["size_mm"].isNotNull())
        & c["cell"]["anomaly"].isNull(),
    )
    return wide.select(*keys, F.posexplode(kept).alias("i", "c")).select(
        *keys,
        (F.col("i") + 1).cast("int").alias("stone_index"),
        F.col("c.cell.side").alias("side"),
        F.col("c.cell.zone").alias("zone"),
        F.col("c.cell.zone_inferred").alias("zone_inferred"),
        F.col("c.size_mm").alias("size_mm"),
        F.col("c.size_mm").isNotNull().alias("size_known"),
        size_class(F.col("c.size_mm")).alias("size_class"),
        F.col("c.source_column").alias("source_column"),
    )


def task_members() -> Column:
    """Names of the tasks on which a row of the side table is defined; apply after the split, never before."""
    stone, zones = F.col("has_stone"), F.col("zone_upper") | F.col("zone_mid") | F.col("zone_lower")
    return F.array_compact(F.array(F.lit("has_stone"), F.when(stone & F.col("max_class").isNotNull(), "size3"), F.when(stone & zones, "zone")))


def task_sizes(rows: DataFrame, case: str) -> DataFrame:
    """Rows and distinct cases of each task, also of one without rows. The rows of a case meet in one row of counts, so a
    case is held once and not once for each task."""
    tasks = ("has_stone", "size3", "zone")
    per = rows.groupBy(case).agg(*[F.count_if(F.array_contains(task_members(), t)).alias(f"__{t}") for t in tasks])
    total = per.agg(*[
        F.struct(F.lit(t).alias("task"), F.coalesce(F.sum(f"__{t}"), F.lit(0)).alias("n"), F.count_if((F.col(f"__{t}") > 0) & F.col(case).isNotNull()).alias("n_cases")).alias(t)
        for t in tasks
    ])
    return total.select(F.inline(F.array(*tasks)))


def target_of(task: str) -> Column:
    """Target of a task as an array of doubles."""
    from cohortine.functions.scalars import size3, size3_rank

    targets = {
        "has_stone": [F.col("has_stone")],
        "size3": [size3_rank(size3(F.col("max_class")))],
        "zone": [F.col("zone_upper"), F.col("zone_mid"), F.col("zone_lower")],
    }
    return F.array(*[t.cast("double") for t in targets[task]])
