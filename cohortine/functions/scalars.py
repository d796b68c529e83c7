"""Column expressions on single rows: binning, decoding, intervals, number formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortine.functions import vocab as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a costly expression once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def pick(words: Sequence[str], index: Column) -> Column:
    """Element of a fixed word list by zero-based index."""
    return F.get(F.array(*[F.lit(w) for w in words]), index)


def size_class(mm: Column) -> Column:
    """Ordinal size class with half-open bounds; unknown size stays null."""
    out = F.when(mm.isNull() | F.isnan(mm.cast("double")), F.lit(None).cast("string"))
    for bound, name in zip(V.SIZE_BOUNDS, V.SIZE_CLASSES):
        out = out.when(mm < bound, name)
    return out.otherwise(V.SIZE_CLASSES[-1])


def size3(cls: Column) -> Column:
    """Five size classes reduced to three."""
    return lookup(cls, V.SIZE3)


def size3_rank(cls3: Column) -> Column:
    """0, 1, 2 for the three classes, -1 for anything else."""
    rank = F.array_position(F.array(*[F.lit(c) for c in V.SIZE3_NAMES]), cls3)
    return F.coalesce(rank.cast("int") - 1, F.lit(-1))


def count_bucket(n: Column, qualifier: Column) -> Column:
    """Named bucket of a count; MANY and unknown come first."""
    return (
        F.when((qualifier == "MANY") | n.isNull(), "MANY_UNSPECIFIED")
        .when(n <= 0, "0")
        .when(n == 1, "1")
        .when(n == 2, "2")
        .when(n <= 4, "3-4")
        .when(n <= 9, "5-9")
        .otherwise("10+")
    )


def diameter_bucket(mm: Column) -> Column:
    """Half-open diameter stratum; null keeps its own stratum (null)."""
    out = F.when(mm.isNull() | F.isnan(mm.cast("double")), F.lit(None).cast("string"))
    for name, lo, hi in V.DIAMETER_BUCKETS:
        out = out.when((mm >= lo) & (mm < hi), name)
    return out


def right_closed_bin(x: Column, edges: Sequence[float] = V.RIGHT_CLOSED_EDGES) -> Column:
    """Label of the right-closed interval (lo, hi] that holds the value."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        hit, label = (x > lo) & (x <= hi), f"({lo}, {hi}]"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def plausible(extent: Column, volume: Column, has_mask: Column) -> Column:
    """Range check that is null, not false, when there is no measurement."""
    ok = F.coalesce(
        extent.between(*V.EXTENT_RANGE_MM) & volume.between(*V.VOLUME_RANGE_MM3), F.lit(False)
    )
    return F.when(has_mask, ok)


def plane_class(iop: Sequence[Column]) -> Column:
    """Axis of the normal of two direction vectors."""
    nx, ny, nz = cross(iop)
    ax, ay, az = F.abs(nx), F.abs(ny), F.abs(nz)
    top = F.greatest(ax, ay, az)
    bad = F.lit(False)
    for c in iop:
        c = c.cast("double")
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (
        F.when(bad, "UNKNOWN")
        .when(top < 0.95, "OBLIQUE")
        .when(ax == top, "SAGITTAL")
        .when(ay == top, "CORONAL")
        .otherwise("AXIAL")
    )


def cross(iop: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Cross product of the row and column direction."""
    a, b, c, d, e, f = iop
    return b * f - c * e, c * d - a * f, a * e - b * d


def unit_normal(iop: Sequence[Column]) -> list[Column]:
    """Unit normal; [0, 0, 1] when the directions are missing or parallel."""
    parts = cross(iop)
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    ok = norm > 0
    return [
        F.when(ok, F.try_divide(p, norm)).otherwise(F.lit(default))
        for p, default in zip(parts, (0.0, 0.0, 1.0))
    ]


def reject_reason(
    is_localizer: Column,
    n_slices: Column,
    rows: Column,
    columns: Column,
    plane: Column,
    extent: Column,
) -> Column:
    """First reason to reject a series; null means accepted."""
    return (
        F.when(is_localizer, "localizer")
        .when(n_slices < V.MIN_SLICES, "too_few_slices")
        .when((rows != V.MATRIX) | (columns != V.MATRIX), "nonstandard_matrix")
        .when(plane == "OBLIQUE", "oblique")
        .when(plane == "UNKNOWN", "no_orientation")
        .when((plane == "AXIAL") & (extent < V.MIN_EXTENT_MM), "insufficient_coverage")
    )


def effective_count(declared: Column, listed: Column, qualifier: Column) -> Column:
    """Count that is unknown for MANY and never below the listed items."""
    return F.when(qualifier == "MANY", F.lit(None)).otherwise(
        F.greatest(F.coalesce(declared, listed), listed)
    )


def side_count(n_side: Column, declared: Column, listed: Column, qualifier: Column) -> Column:
    """Items on one side; null when undescribed items could be on it."""
    unknown = (qualifier == "MANY") | (
        (qualifier == "EXACT") & (F.coalesce(declared, F.lit(0)) > listed)
    )
    return F.when(~unknown, n_side)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) when there are no trials."""
    k, n = k.cast("double"), n.cast("double")
    safe = F.nullif(n, F.lit(0.0))
    p = k / safe
    d = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / d
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / d
    return F.coalesce(centre - half, F.lit(0.0)), F.coalesce(centre + half, F.lit(1.0))


def window8(x: Column, level: float, width: float) -> Column:
    """Linear intensity window to 0..255, clipped, rounded half to even."""
    share = (x.cast("double") - F.lit(level - width / 2.0)) / F.lit(float(width))
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.bround(clipped * 255.0, 0).cast("int")


def window_stack(x: Column) -> Column:
    """The three windows in their fixed order."""
    return F.array(*[window8(x, *V.WINDOWS[name]) for name in V.WINDOW_ORDER])


def encode_offset(hu: Column) -> Column:
    """Stored value of an intensity; null when it cannot be stored."""
    return F.when(hu.between(V.HU_MIN, V.HU_MAX), hu.cast("int") + V.HU_OFFSET)


def decode_offset(stored: Column) -> Column:
    return stored.cast("int") - V.HU_OFFSET


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def ordinal_decode(logit_mid: Column, logit_top: Column) -> tuple[Column, Column]:
    """Class 0..2 and three probabilities from two ordered thresholds."""
    p_mid = sigmoid(logit_mid)
    p_top = F.least(sigmoid(logit_top), p_mid)
    cls = (p_mid > 0.5).cast("int") + (p_top > 0.5).cast("int")
    return cls, F.array(1 - p_mid, p_mid - p_top, p_top)


def zone_scores(z: Column) -> Column:
    """Scores for upper, mid and lower from a position in 0..1."""
    return F.array(z, -F.abs(z - 0.5), -z)


def zone_of(z: Column, low: Column, high: Column) -> Column:
    """Zone name by two thresholds."""
    return pick(V.SINGLE_ZONES, (z >= low).cast("int") + (z >= high).cast("int"))


def decode_prob(cell: Column) -> Column:
    """JSON scalar or JSON array in a text cell as an array of doubles."""
    text = F.trim(cell)
    return F.when(text.startswith("["), F.from_json(text, "array<double>")).otherwise(
        F.array(text.try_cast("double"))
    )


def mm_text(mm: Column) -> Column:
    """Whole numbers without a fraction, other numbers in their shortest form."""
    whole = mm == F.floor(mm)
    return F.when(mm.isNull(), "").when(whole, mm.cast("bigint").cast("string")).otherwise(
        mm.cast("string")
    )


def article_en(number: Column) -> Column:
    """"an" before numbers that are read with a leading vowel."""
    whole = F.substring_index(number, ".", 1)
    return F.when(whole.startswith("8") | whole.isin("11", "18"), "an").otherwise("a")


def repair_number(token: Column) -> Column:
    """Letters that stand for digits turned back into digits."""
    return F.translate(token, V.DIGIT_FROM, V.DIGIT_TO)


def parse_int_token(token: Column) -> Column:
    """Strict integer after repair, else null."""
    fixed = F.trim(repair_number(token))
    return F.when(fixed.rlike(r"^\d+$"), fixed.try_cast("bigint"))


def salted_hash(value: Column, salt: str, length: int = 16) -> Column:
    """Prefix of a salted SHA-256 digest."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, length)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return seconds * 1000000 + micros
