"""Ordered numbering and running totals that do not put a whole group into one task.

A plain window sorts every row of its partition in one task, so one hot key (or no key
at all) decides the run time. The functions here cut an order into cells, work inside
the cells in parallel and add the totals of the earlier cells, which are few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group of more rows is cut into cells of about so many; cells of a group at most.
ROWS_PER_CELL = 1_000_000
MOST_CELLS = 256
HASH_HEX = 3


def _spread(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Number of rows and evenly filled split points of a value, by a mergeable sketch."""
    steps = F.array(*(F.lit(i / MOST_CELLS) for i in range(1, MOST_CELLS)))
    aggs = F.count(F.lit(1)).alias("__n"), F.percentile_approx(value.cast("double"), steps, 20 * MOST_CELLS).alias("__q")
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def _splits(rows_per_cell: int) -> Column:
    """Those of the split points that leave a cell about so many rows; none where one cell is enough."""
    every = F.greatest(F.lit(1), F.floor(F.lit(MOST_CELLS) / F.ceil(F.col("__n") / F.lit(rows_per_cell))))
    return F.filter("__q", lambda _, i: (i + 1) % every == 0)


def splits(df: DataFrame, keys: Sequence[str], value: Column, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(keys, __s): the split points of each group of more than ``rows_per_cell`` rows with a value.

    They are quantiles, so it does not matter where the values of a group crowd. There are at most rows / rows_per_cell such
    groups, and 2 * rows / rows_per_cell split points together, a million for 5 * 10 ** 11 rows; that bounds what is
    broadcast here and by those who join with them. A join by the group's key would bring a large group into one task.
    """
    valued = df.where(value.isNotNull())
    if keys:
        large = valued.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_cell)
        valued = valued.join(F.broadcast(large.select(*keys)), list(keys), "left_semi")
    return _spread(valued, keys, value).select(*keys, _splits(rows_per_cell).alias("__s"))


def cut(df: DataFrame, keys: Sequence[str], value: Column, points: DataFrame, large: bool = False) -> DataFrame:
    """df with ``__cell``, monotone in the value inside each group and about evenly filled, by the groups' split points.

    A value more frequent than a cell shares its cell with less than one cell of other rows. Rows without a value are in the first cell, and so are all rows
    of a group without split points; ``large`` leaves such groups out.
    """
    if keys:
        tagged = df.join(F.broadcast(points), list(keys), "inner" if large else "left")
    else:
        tagged = df.withColumn("__s", points.scalar())
    below = F.size(F.filter("__s", lambda x: x < value.cast("double")))
    return tagged.withColumn("__cell", F.when(F.col("__s").isNull(), 0).otherwise(below)).drop("__s")


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    lead: Column,
    name: str = "rn",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """row_number() inside ``by`` that cuts large groups; see ``splits``.

    ``lead`` is a numeric expression that never decreases along ``order``.
    """
    keys = list(by)
    points = splits(df, keys, lead, rows_per_cell)
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    numbered = cut(df, keys, lead, points).withColumn("__inside", F.row_number().over(inside))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut(df, keys, lead, points, large=True).groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__before", F.sum("__m").over(earlier)).drop("__m")
    )
    return (
        numbered.join(offsets, [*keys, "__cell"], "left")
        .withColumn(name, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("bigint"))
        .drop("__inside", "__before", "__cell")
    )


def hash_positions(df: DataFrame, by: Sequence[str], digest: str, name: str = "rn") -> DataFrame:
    """Position of each row in the order of a hexadecimal digest, inside ``by``.

    The first digits of a digest are uniform, so they are the cells; a group may hold
    any number of rows.
    """
    keys = list(by)
    tagged = df.withColumn("__cell", F.substring(F.col(digest), 1, HASH_HEX))
    inside = Window.partitionBy(*keys, "__cell").orderBy(digest)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "__cell")
        .agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0)))
        .drop("__m")
    )
    return (
        tagged.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*keys, "__cell"])
        .withColumn(name, (F.col("__inside") + F.col("__before")).cast("bigint"))
        .drop("__inside", "__before", "__cell")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Sequence[str],
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Inclusive running sums ``cum_<measure>`` and totals ``all_<measure>`` along ``value``.

    ``df`` holds one row per (by, value); large groups are cut, see ``splits``.
    """
    keys = list(by)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    tagged = cut(df, keys, F.col(value), splits(df, keys, F.col(value), rows_per_cell))
    across = Window.partitionBy(*group)
    earlier = across.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy(*keys, "__cell").agg(*[F.sum(m).alias(f"__{m}") for m in measures])
    for m in measures:
        sums = sums.withColumn(f"__b_{m}", F.coalesce(F.sum(f"__{m}").over(earlier), F.lit(0)))
        sums = sums.withColumn(f"all_{m}", F.sum(f"__{m}").over(across))
    sums = sums.drop(*[f"__{m}" for m in measures])
    inside = (
        Window.partitionBy(*keys, "__cell")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = tagged
    for m in measures:
        out = out.withColumn(f"__c_{m}", F.sum(m).over(inside))
    out = out.join(sums, [*keys, "__cell"])
    for m in measures:
        out = out.withColumn(f"cum_{m}", F.col(f"__c_{m}") + F.col(f"__b_{m}"))
    return out.drop("__cell", *[f"__c_{m}" for m in measures], *[f"__b_{m}" for m in measures])


def mid_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Average ranks of ``value`` inside ``by``, as a table of distinct values.

    Columns: by, value, n (ties), mid_rank, all_n and the sums of the ``carry`` columns.
    """
    keys = list(by)
    dense = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in carry]
    )
    ranked = running_totals(dense, keys, value, ["n"])
    return ranked.withColumn("mid_rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)


def group_medians(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str = "median",
) -> DataFrame:
    """Exact median of ``value`` per group, from value counts instead of a value buffer."""
    keys = list(by)
    dense = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(dense, keys, value, ["n"])
    low = F.floor((F.col("all_n") + 1) / 2)
    high = F.floor(F.col("all_n") / 2) + 1
    before = F.col("cum_n") - F.col("n")
    takes = ((low > before) & (low <= F.col("cum_n"))).cast("int") + (
        (high > before) & (high <= F.col("cum_n"))
    ).cast("int")
    return (
        ranked.withColumn("__t", takes)
        .where(F.col("__t") > 0)
        .groupBy(*keys)
        .agg((F.sum(F.col(value) * F.col("__t")) / 2.0).alias(name))
    )


def group_modes(df: DataFrame, by: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name)
    )


def ordered_gaps(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str = "gap",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Differences of neighbouring sorted values inside ``by``; one row per gap.

    Large groups are cut into cells; the gap over a cell border comes from the ends of the two cells.
    """
    keys = list(by)
    rows, x = df.where(F.col(value).isNotNull()), F.col(value)
    points = splits(rows, keys, x, rows_per_cell)
    inside = Window.partitionBy(*keys, "__cell").orderBy(value)
    inner = (
        cut(rows, keys, x, points).withColumn(name, F.col(value) - F.lag(value).over(inside))
        .where(F.col(name).isNotNull())
        .select(*keys, name)
    )
    across = Window.partitionBy(*keys).orderBy("__cell")
    borders = (
        cut(rows, keys, x, points, large=True)
        .groupBy(*keys, "__cell")
        .agg(F.min(value).alias("__first"), F.max(value).alias("__last"))
        .withColumn(name, F.col("__first") - F.lag("__last").over(across))
        .where(F.col(name).isNotNull())
        .select(*keys, name)
    )
    return inner.unionByName(borders)
