"""Text cells to facts: zone cells, free-text findings, delimited findings, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.functions.names import ascii_upper, strip
from cohortine.functions.scalars import let, parse_int_token, repair_number


def parse_zone_cell(raw: Column) -> Column:
    """Struct of side, zone, zone_inferred, anomaly and note from one zone cell."""
    folded = strip(ascii_upper(F.coalesce(raw, F.lit(""))))
    return let(folded, lambda txt: let(_anomaly(txt), lambda a: F.struct(*_zone_columns(txt, a, strip(raw)))))


def with_zone(df: DataFrame, raw: Column, prefix: str = "") -> DataFrame:
    """df with side, zone, zone_inferred, anomaly and note of a zone cell. Each step is a plain column, so that all of it
    compiles; a repeated folding is not inlined again."""
    txt, found = f"__{prefix}folded", f"__{prefix}anomaly"
    df = df.withColumn(txt, strip(ascii_upper(F.coalesce(raw, F.lit("")))))
    df = df.withColumn(found, _anomaly(F.col(txt)))
    return df.select("*", *_zone_columns(F.col(txt), F.col(found), strip(raw), prefix)).drop(txt, found)


def _anomaly(txt: Column) -> Column:
    return (
        F.when(txt.contains("AT NALI"), "HORSESHOE_KIDNEY")
        .when(txt.contains("COK SAYIDA") & txt.contains("BUYUK TAS"), "MANY_SMALL_STONES_MIMIC_LARGE")
        .when(txt.contains("HIPERDENS") & txt.contains("PIRAMIS"), "HYPERDENSE_PYRAMID_MIMIC")
        .when(txt.contains("KIST") | txt.contains("LEZYON"), "COMPLICATED_CYST_HYPERDENSE_LESION")
    )


def _zone_columns(txt: Column, anomaly: Column, note: Column, prefix: str = "") -> list[Column]:
    side = (
        F.when(anomaly.isNotNull(), "UNKNOWN")
        .when(txt.rlike(r"\bSAG\b|\bSA\b(?!L)") | txt.startswith("SAG"), "RIGHT")
        .when(txt.contains("SOL"), "LEFT")
        .otherwise("UNKNOWN")
    )
    cut_short = txt.rlike(r"\bOR\b")
    zone = (
        F.when(anomaly.isNotNull(), "UNKNOWN")
        .when(txt.contains("ORTA-UST") | txt.contains("ORTA UST"), "MID_UPPER")
        .when(txt.contains("ORTA ALT") | txt.contains("ORTA-ALT"), "MID_LOWER")
        .when(txt.contains("ALT"), "LOWER")
        .when(txt.contains("UST"), "UPPER")
        .when(txt.contains("ORTA"), "MID")
        .when(cut_short, "MID")
        .otherwise("UNKNOWN")
    )
    named = txt.rlike("ALT|UST|ORTA")
    completed = anomaly.isNull() & cut_short & ~named
    inferred = completed | (~named & ~cut_short & (side != "UNKNOWN"))
    return [
        side.alias(prefix + "side"),
        zone.alias(prefix + "zone"),
        inferred.alias(prefix + "zone_inferred"),
        anomaly.alias(prefix + "anomaly"),
        F.when(anomaly.isNotNull() | completed, note).alias(prefix + "note"),
    ]


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_free_text(text: Column) -> Column:
    """Struct of laterality cue, largest finding and declared count from a sentence."""
    return let(ascii_upper(F.coalesce(text, F.lit(""))), _free_text_struct)


def _free_text_struct(txt: Column) -> Column:
    ambiguous = txt.rlike(V.AMBIGUOUS_LEFT_CUE)
    cue = F.when(ambiguous, "LEFT")
    for pattern, value in V.LATERALITY_CUES:
        cue = cue.when(txt.rlike(pattern), value)
    side_word = _found(txt, V.LARGEST_PATTERN, 1)
    zone_word = _found(txt, V.LARGEST_PATTERN, 2)
    side = (
        F.when(zone_word.isNull(), "UNKNOWN")
        .when(side_word == "SAG", "RIGHT")
        .when(side_word == "SOL", "LEFT")
        .when(cue.isin("RIGHT", "LEFT"), cue)
        .otherwise("UNKNOWN")
    )
    zone = (
        F.when(zone_word == "ALT", "LOWER")
        .when(zone_word == "ORTA", "MID")
        .when(zone_word == "UST", "UPPER")
        .otherwise("UNKNOWN")
    )
    token = _found(txt, V.COUNT_PATTERN, 1)
    declared = parse_int_token(token)
    return F.struct(
        cue.alias("laterality_cue"),
        ambiguous.alias("laterality_ambiguous"),
        side.alias("largest_side"),
        zone.alias("largest_zone"),
        _number(_found(txt, V.MM_PATTERN, 1)).alias("largest_mm"),
        declared.alias("declared_count"),
        F.coalesce(declared.isNotNull() & (token != repair_number(token)), F.lit(False)).alias(
            "count_repaired"
        ),
    )


def finding_rows(df: DataFrame, text: str, position: str = "pos") -> DataFrame:
    """A row for each part of a semicolon-separated finding, numbered from 0, beside the columns of df.

    Adds raw, parsed, zone_raw, side, zone, zone_inferred, anomaly, note, size_mm, size_text and size_class_text. A part that
    is no finding is kept with parsed false and nothing else. The pattern runs once a part; its groups are taken apart at a
    control character, which no part contains.
    """
    cut = "\u0001"
    whole = F.translate(F.coalesce(F.col(text), F.lit("")), cut, " ")
    parts = F.filter(F.transform(F.split(whole, ";"), lambda part: strip(part)), lambda part: part != "")
    rows = df.select("*", F.posexplode(parts).alias(position, "raw"))
    groups = F.split(F.regexp_replace("raw", "(?dU)" + V.LESION_PATTERN, cut.join(["", "$1", "$2", "$3"])), cut)
    rows = rows.withColumn("__g", groups)
    field = lambda i: strip(F.get("__g", F.lit(i)))
    rows = rows.select(
        *(c for c in rows.columns if c != "__g"), (F.size("__g") == 4).alias("parsed"),
        field(1).alias("zone_raw"), field(2).alias("size_text"), field(3).alias("size_class_text"),
    )
    rows = with_zone(rows, F.col("zone_raw"), "__")
    known = lambda c: F.when(F.col("parsed"), F.col("__" + c)).alias(c)
    size = _number(_found(F.col("size_text"), r"^(\d+(?:[.,]\d+)?)\s*mm", 1)).alias("size_mm")
    return rows.select(
        *(c for c in rows.columns if not c.startswith("__")), *map(known, ("side", "zone", "zone_inferred", "anomaly", "note")), size,
    )


def report_style(text: Column) -> Column:
    """STRUCTURED when the lesion keyword occurs, else FREE_TEXT."""
    return F.when(F.coalesce(text, F.lit("")).contains("yerleşimli"), "STRUCTURED").otherwise(
        "FREE_TEXT"
    )


def mask_name_line(text: Column, case_id: Column) -> Column:
    """Identifying line replaced by the pseudonymous id."""
    return F.regexp_replace(text, F.lit(V.NAME_LINE_PATTERN), F.concat(F.lit("Hasta: "), case_id))


def derive_laterality(has_right: Column, has_left: Column, cue: Column) -> Column:
    """Union of the sides and the cue, never one finding alone."""
    cue = F.coalesce(cue, F.lit(""))
    right = F.coalesce(has_right, F.lit(False)) | (cue == "RIGHT")
    left = F.coalesce(has_left, F.lit(False)) | (cue == "LEFT")
    return (
        F.when((cue == "BILATERAL") | (right & left), "BILATERAL")
        .when(right, "RIGHT")
        .when(left, "LEFT")
        .otherwise("NONE")
    )


def parse_sex(raw: Column) -> Column:
    """E and K to M and F, anything else UNKNOWN."""
    code = F.upper(strip(raw))
    return F.when(code == "E", "M").when(code == "K", "F").otherwise("UNKNOWN")


def declared_count(raw: Column) -> Column:
    """Struct of declared count and qualifier from a count cell."""
    text = strip(raw)
    capital = F.upper(text)
    number = text.try_cast("double").try_cast("bigint")
    many = capital.startswith("ÇOK") | capital.startswith("COK")
    return F.struct(
        F.when(~F.coalesce(many, F.lit(False)), number).alias("declared"),
        F.when(text.isNull(), "UNKNOWN")
        .when(many, "MANY")
        .when(number.isNull(), "UNKNOWN")
        .otherwise("EXACT")
        .alias("qualifier"),
    )


def stated_count(conclusion: Column) -> Column:
    """The number before the counting word of a conclusion."""
    return _found(conclusion, V.CONCLUSION_COUNT, 1).try_cast("bigint")
