"""One record per row of a source, and one per case from both sources.

Source rows are parsed in plain columns; arrays hold the few findings of one row and never more than its cells or parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.functions.labels import declared_count, derive_laterality, finding_rows, mask_name_line, parse_free_text, parse_sex, report_style, stated_count, with_zone
from cohortine.functions.names import strip
from cohortine.functions.scalars import count_bucket, effective_count, size_class

FINDING = "struct<stone_index:int,side:string,zone:string,zone_raw:string,zone_inferred:boolean,size_mm:double,size_known:boolean,size_class:string,source_column:string>"
CONFLICT = "array<struct<field:string,primary:array<string>,secondary:string,resolved:boolean>>"


def primary_records(
    wide: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], count: str, age: str, sex: str
) -> DataFrame:
    """One record per wide row: its findings, anomalies and notes in the order of the cells, count, age and sex.

    A cell pair without zone and size is nothing. A cell that names an anomaly is no finding, whatever its size; its text is
    a note. A completed zone word is a note too. Anomalies are distinct and sorted.
    """
    named = lambda c: F.col(f"`{c}`")
    df = wide
    for n, (zone, mm) in enumerate(pairs):
        df = with_zone(df, named(zone), f"c{n}_").withColumns({f"c{n}_raw": strip(named(zone)), f"c{n}_mm": named(mm).cast("double")})
    cells = F.array(
        *(
            F.struct(
                *(F.col(f"c{n}_{c}").alias(c) for c in ("side", "zone", "raw", "zone_inferred", "anomaly", "note", "mm")),
                size_class(F.col(f"c{n}_mm")).alias("class"), F.lit(zone.strip()).alias("source"),
            )
            for n, (zone, _) in enumerate(pairs)
        )
    )
    held = F.filter(cells, lambda c: c["raw"].isNotNull() | c["mm"].isNotNull())
    df = df.select(*keys, held.alias("held"), named(count).alias("__count"), named(age).alias("__age"), named(sex).alias("__sex"))
    stones = F.transform(
        F.filter("held", lambda c: c["anomaly"].isNull()),
        lambda c, i: F.struct(
            (i + 1).alias("stone_index"), c["side"].alias("side"), c["zone"].alias("zone"), c["raw"].alias("zone_raw"), c["zone_inferred"].alias("zone_inferred"),
            c["mm"].alias("size_mm"), c["mm"].isNotNull().alias("size_known"), c["class"].alias("size_class"), c["source"].alias("source_column"),
        ),
    )
    counted = declared_count(F.col("__count").cast("string"))
    return df.select(
        *keys, stones.cast(f"array<{FINDING}>").alias("stones"),
        F.array_sort(F.array_distinct(F.array_compact(F.col("held.anomaly")))).alias("anomalies"), F.array_compact(F.col("held.note")).alias("notes"),
        counted["declared"].alias("stone_count_declared"), counted["qualifier"].alias("count_qualifier"),
        F.col("__age").cast("int").alias("age_years"), parse_sex(F.col("__sex")).alias("sex"), strip(F.col("__sex")).alias("sex_source_raw"),
    )


def secondary_records(reports: DataFrame, key: str, findings: str, conclusion: str, whole: str) -> DataFrame:
    """One record per report row: style, findings of a structured text, cues of a free one, the count its conclusion states.

    Each parser sees only the rows of its style; both give the same columns. `key` tells rows apart.
    """
    text = F.coalesce(F.col(findings), F.lit(""))
    df = reports.select(key, text.alias("text"), F.col(conclusion).alias("conclusion"), F.col(whole).alias("whole"), report_style(text).alias("report_style"))
    structured = F.col("report_style") == "STRUCTURED"
    part = ("pos", "raw", "parsed", "zone_raw", "side", "zone", "zone_inferred", "anomaly", "note", "size_mm", "size_text", "size_class_text")
    lesions = (
        finding_rows(df.where(structured).select(key, "text"), "text")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*part))).alias("lesions"))
    )
    kind = lesions.schema["lesions"].dataType
    return df.join(lesions, key, "left").select(
        key, "report_style", F.coalesce("lesions", F.array().cast(kind)).alias("lesions"),
        parse_free_text(F.when(~structured, F.col("text"))).alias("free"), stated_count(F.col("conclusion")).alias("stated"),
        F.nullif("text", F.lit("")).alias("findings_text"), F.col("conclusion").alias("conclusion_text"), F.col("whole").alias("whole_text"),
    )


def case_records(cases: DataFrame, primary: DataFrame, secondary: DataFrame, rules: DataFrame) -> DataFrame:
    """One record per case: primary over secondary, then the case's adjudication, each step leaving its name in `steps`.

    All four are keyed by case_id. Cases may carry `collection`. `rules` has flip_sides (map of side to side),
    force_laterality, method, evidence and conflict (field, primary, secondary), each of them nullable.

    The steps, in order: BORROWED, the largest finding of a free text stands in for an empty list; CONFLICT, the cue names a
    side on which nothing is listed; FLIPPED, a rule exchanges sides; FORCED, it sets the laterality; DECLARED, it brings
    the conflict that it resolves, where none was found. A rule resolves every conflict of its case.
    """
    p = primary.select("case_id", F.struct(*(c for c in primary.columns if c != "case_id")).alias("p"))
    s = secondary.select("case_id", F.struct(*(c for c in secondary.columns if c != "case_id")).alias("s"))
    r = rules.select("case_id", F.struct("flip_sides", "force_laterality", "method", "evidence", "conflict").alias("r"))
    df = cases.join(p, "case_id", "left").join(s, "case_id", "left").join(r, "case_id", "left")

    # the free text lends its largest finding
    mm = F.col("s.free.largest_mm")
    df = df.withColumn("borrowed", F.coalesce(F.size("p.stones"), F.lit(0)).isin(0, -1) & F.coalesce(mm != 0, F.lit(False)))
    lent = F.struct(
        F.lit(1).alias("stone_index"), F.col("s.free.largest_side").alias("side"), F.col("s.free.largest_zone").alias("zone"), F.lit(None).cast("string").alias("zone_raw"),
        F.lit(True).alias("zone_inferred"), mm.alias("size_mm"), F.lit(True).alias("size_known"), size_class(mm).alias("size_class"), F.lit("free_text").alias("source_column"),
    ).cast(FINDING)
    df = df.withColumn("stones", F.when(F.col("borrowed"), F.array(lent)).otherwise(F.coalesce("p.stones", F.array().cast(f"array<{FINDING}>"))))

    # conflicts are found on the sides as they stand before a rule
    sides = F.array_sort(F.array_intersect(F.array(F.lit("LEFT"), F.lit("RIGHT")), F.col("stones.side")))
    df = df.withColumn("sides", sides).withColumn("cue", F.col("s.free.laterality_cue"))
    ruled = F.col("r").isNotNull()
    found = F.col("cue").isin("RIGHT", "LEFT") & (F.size("sides") > 0) & ~F.array_contains("sides", F.col("cue"))
    df = df.withColumn("found", F.coalesce(found, F.lit(False)))
    declares = ~F.col("found") & F.col("r.conflict").isNotNull()
    conflict = lambda field, primary, secondary: F.array(F.struct(field.alias("field"), primary.alias("primary"), secondary.alias("secondary"), ruled.alias("resolved"))).cast(CONFLICT)
    df = df.withColumn(
        "conflicts",
        F.when(F.col("found"), conflict(F.lit("stone_side"), F.col("sides"), F.col("cue")))
        .when(declares, conflict(F.col("r.conflict.field"), F.col("r.conflict.primary"), F.col("r.conflict.secondary")))
        .otherwise(F.array().cast(CONFLICT)),
    )

    # a rule acts on every finding
    flips = F.col("r.flip_sides").isNotNull()
    df = df.withColumn("stones", F.when(flips, F.transform("stones", lambda x: x.withField("side", F.coalesce(F.try_element_at(F.col("r.flip_sides"), x["side"]), x["side"])))).otherwise(F.col("stones")))
    held = lambda side: F.array_contains(F.col("stones.side"), side)
    df = df.withColumn("laterality", F.coalesce("r.force_laterality", derive_laterality(held("RIGHT"), held("LEFT"), F.col("cue"))))

    stated = F.col("p.stone_count_declared").isNull() & F.col("s.stated").isNotNull()
    df = df.withColumns({
        "declared": F.coalesce("p.stone_count_declared", "s.stated"),
        "qualifier": F.when(stated, "EXACT").otherwise(F.coalesce("p.count_qualifier", F.lit("UNKNOWN"))), "listed": F.size("stones").cast("bigint"),
    })
    df = df.withColumn("n_effective", effective_count(F.col("declared"), F.col("listed"), F.col("qualifier")))
    anomalies = F.coalesce("p.anomalies", F.array().cast("array<string>"))
    if "collection" in cases.columns:
        ureter = F.coalesce(F.col("collection").contains(V.URETER_COLLECTION), F.lit(False))
        anomalies = F.when(ureter, F.array_union(anomalies, F.array(F.lit("URETERAL_STONE_PRESENT")))).otherwise(anomalies)
    step = lambda name, when: F.when(when, name)
    free = F.col("s.report_style") == "FREE_TEXT"
    whole = mask_name_line(F.col("s.whole_text"), F.col("case_id").cast("string"))
    return df.select(
        "case_id", F.coalesce("s.report_style", F.lit("ABSENT")).alias("report_style"), F.col("p.age_years").alias("age_years"),
        F.coalesce("p.sex", F.lit("UNKNOWN")).alias("sex"), F.col("p.sex_source_raw").alias("sex_source_raw"),
        F.col("declared").alias("stone_count_declared"), F.col("listed").alias("stone_count_listed"), F.col("qualifier").alias("count_qualifier"),
        F.coalesce((F.col("qualifier") == "EXACT") & (F.col("declared") != F.col("listed")), F.lit(False)).alias("count_mismatch"),
        F.col("n_effective").alias("n_stones_effective"), count_bucket(F.col("n_effective"), F.col("qualifier")).alias("count_bucket"),
        "laterality", "stones", F.array_sort(anomalies).alias("anomalies"), F.when(free, F.col("s.findings_text")).alias("free_text_note"),
        F.coalesce("s.free.laterality_ambiguous", F.lit(False)).alias("free_text_laterality_ambiguous"), "conflicts",
        F.when(ruled, F.struct(F.col("r.method").alias("method"), F.col("r.evidence").alias("evidence"))).alias("adjudication"),
        F.coalesce("p.notes", F.array().cast("array<string>")).alias("notes"),
        F.struct(F.col("s.findings_text").alias("findings"), F.col("s.conclusion_text").alias("conclusion"), whole.alias("whole")).alias("original_report"),
        F.array_compact(F.array(
            step("BORROWED", F.col("borrowed")), step("CONFLICT", F.col("found")), step("FLIPPED", flips),
            step("FORCED", F.col("r.force_laterality").isNotNull()), step("DECLARED", declares),
        )).alias("steps"),
    )


def told(items: Column, *fields: str) -> Column:
    """The fields of an array of structs as one text: fields split by colons, items by semicolons, null as a dash."""
    word = lambda x, f: F.coalesce(x[f].cast("string"), F.lit("-"))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *(word(x, f) for f in fields))), ";")
