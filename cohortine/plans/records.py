"""Queries on the records of sources and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.functions import scalars, vocab
from cohortine.operators import records
from cohortine.operators.records import told
from cohortine.plans.registry import query
from cohortine.plans.rows import SIDE_FROM_KEY, SIZE_CASE, ZONE_FROM_KEY, free_text
from cohortine.sources import fixtures as fx
from cohortine.sources.tables import table

PAIRS = [(f"zone_{i}", f"mm_{i}") for i in (1, 2, 3)]


def primary(spark, folder):
    """Wide rows of the orders whose customer is no multiple of five."""
    wide = fx.primary_rows(spark, folder).where("patient_id % 5 > 0")
    wide = wide.withColumn("age_raw", F.when(F.col("patient_id") % 13 > 0, (F.col("patient_id") % 90).cast("double")))
    return records.primary_records(wide, ["case_id"], PAIRS, "count_raw", "age_raw", "sex_raw")


def report_rows(spark, folder):
    """Structured findings for even keys, one sentence for odd ones; every third conclusion states a count."""
    o = free_text(spark, folder).withColumnRenamed("text", "sentence")
    key, cust = F.col("case_id"), F.col("patient_id")
    size = F.concat((cust % 40 + 1).cast("string"), F.when(cust % 2 == 0, ",5").otherwise(""))
    parts = F.concat(
        fx.zone_cell(key, cust), F.lit("  yerleşimli, "), size, F.lit(" mm ("), scalars.lookup(scalars.size_class((cust % 40 + 1).cast("double")), vocab.SIZE_CLASS_TR), F.lit(");"),
        F.when(key % 3 == 0, " ;\n").otherwise(" "), fx.zone_cell(key + 1, cust + 1), F.lit(" yerleşimli, boyut belirtilmemiş (Bilinmiyor)"),
        F.when(key % 11 == 0, "; izlem önerilir").otherwise(""), F.when(key % 13 == 0, "; SAĞ\nALT yerleşimli, 5 mm (Küçük taş)").otherwise(""),
    )
    return o.select(
        "case_id", "patient_id", F.when(key % 2 == 0, parts).otherwise(F.col("sentence")).alias("findings"),
        F.when(key % 3 == 0, F.concat((key % 9).cast("string"), F.lit(" adet taş"))).when(key % 3 == 1, "taş").alias("conclusion"),
        F.concat(F.lit("Hasta : A B\nNo "), key.cast("string")).alias("whole"),
    )


def secondary(spark, folder):
    return records.secondary_records(report_rows(spark, folder), "case_id", "findings", "conclusion", "whole")


SIDE_WORD = "CASE {s} % 3 WHEN 0 THEN 'SAĞ ' WHEN 1 THEN 'SOL ' ELSE 'sağ ' END"
ANOMALY = "CASE {p} % 9 WHEN 7 THEN 'HORSESHOE_KIDNEY' WHEN 8 THEN 'MANY_SMALL_STONES_MIMIC_LARGE' END"
NOTE = "CASE {p} % 9 WHEN 5 THEN " + SIDE_WORD + " || 'OR' WHEN 7 THEN 'AT NALI BÖBREK MEVCUT' WHEN 8 THEN 'ÇOK SAYIDA KÜÇÜK TAŞ, BÜYÜK TAŞ İZLENİMİ' END"


def _cell(col: int, p: str, s: str, mm: str, rule: str) -> str:
    return (
        f"SELECT o_orderkey AS case_id, {col} AS col, {SIDE_FROM_KEY.format(p=p, s=s)} AS side, {ZONE_FROM_KEY.format(p=p)} AS zone, {p} % 9 IN (5, 6) AS inferred, "
        f"{ANOMALY.format(p=p)} AS anomaly, {NOTE.format(p=p, s=s)} AS note, {mm} AS mm FROM orders WHERE o_custkey % 5 > 0 AND {rule}"
    )


PRIMARY_SQL = f"""p_cell AS ({_cell(1, "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 50 + 1)::DOUBLE END", "true")}
    UNION ALL {_cell(2, "(o_orderkey + 4)", "(o_custkey + 1)", "(o_custkey % 30 + 1) / 2.0::DOUBLE", "o_orderkey % 3 = 0")}
    UNION ALL SELECT o_orderkey, 3, 'UNKNOWN', 'UNKNOWN', false, NULL, NULL, (o_custkey % 40 + 1)::DOUBLE FROM orders WHERE o_custkey % 5 > 0 AND o_orderkey % 5 = 0),
  p_stone AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY col) AS i, {SIZE_CASE.format(x="mm")} AS cls, 'zone_' || col AS source FROM p_cell WHERE anomaly IS NULL),
  p_rec AS (SELECT o_orderkey AS case_id, o_orderkey % 7 AS q, CASE WHEN o_orderkey % 7 IN (1, 2, 3, 4) THEN o_orderkey % 7 WHEN o_orderkey % 7 = 6 THEN 7 END AS declared,
    CASE o_orderkey % 7 WHEN 0 THEN 'MANY' WHEN 5 THEN 'UNKNOWN' ELSE 'EXACT' END AS qualifier, CASE WHEN o_custkey % 13 > 0 THEN (o_custkey % 90)::INTEGER END AS age_years,
    CASE o_custkey % 4 WHEN 0 THEN 'M' WHEN 3 THEN 'UNKNOWN' ELSE 'F' END AS sex FROM orders WHERE o_custkey % 5 > 0),
  p_cells AS (SELECT case_id, coalesce(string_agg(DISTINCT anomaly, ',' ORDER BY anomaly), '') AS anomalies, coalesce(string_agg(note, '|' ORDER BY col), '') AS notes FROM p_cell GROUP BY 1)"""


def _stones(side: str = "side") -> str:
    return f"string_agg(i || ':' || {side} || ':' || zone || ':' || inferred || ':' || coalesce(mm::VARCHAR, '-') || ':' || coalesce(cls, '-') || ':' || source, ';' ORDER BY i)"


STONE = ("stone_index", "side", "zone", "zone_inferred", "size_mm", "size_class", "source_column")


@query(
    "primary_records",
    f"""WITH {PRIMARY_SQL}, s AS (SELECT case_id, {_stones()} AS stones FROM p_stone GROUP BY 1)
    SELECT r.case_id, coalesce(s.stones, '') AS stones, c.anomalies, c.notes, r.declared::BIGINT AS stone_count_declared, r.qualifier AS count_qualifier, r.age_years, r.sex
    FROM p_rec r LEFT JOIN s ON s.case_id = r.case_id LEFT JOIN p_cells c ON c.case_id = r.case_id""",
)
def _(spark, folder):
    return primary(spark, folder).select(
        "case_id", told(F.col("stones"), *STONE).alias("stones"), F.array_join("anomalies", ",").alias("anomalies"), F.array_join("notes", "|").alias("notes"),
        "stone_count_declared", "count_qualifier", "age_years", "sex",
    )


def _part(pos: str, p: str, s: str, mm: str, rule: str) -> str:
    return (
        f"SELECT o_orderkey AS case_id, {pos} AS pos, 'true:' || {SIDE_FROM_KEY.format(p=p, s=s)} || ':' || {ZONE_FROM_KEY.format(p=p)} || ':' || ({p} % 9 IN (5, 6)) || ':' || "
        f"coalesce({ANOMALY.format(p=p)}, '-') || ':' || coalesce({NOTE.format(p=p, s=s)}, '-') || ':' || {mm} AS part FROM orders WHERE o_orderkey % 2 = 0 AND {rule}"
    )


_MM = "((o_custkey % 40 + 1) + CASE WHEN o_custkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)::VARCHAR"
FREE_SQL = """free AS (SELECT o_orderkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'BILATERAL' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'LEFT' WHEN 3 THEN 'LEFT' ELSE 'BILATERAL' END AS cue,
    o_orderkey % 5 = 3 AS ambiguous, CASE o_custkey % 3 WHEN 0 THEN 'RIGHT' WHEN 1 THEN 'LEFT' ELSE CASE o_orderkey % 5 WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'LEFT' WHEN 3 THEN 'LEFT' ELSE 'UNKNOWN' END END AS ls,
    CASE o_orderkey % 3 WHEN 0 THEN 'LOWER' WHEN 1 THEN 'MID' ELSE 'UPPER' END AS lz, (o_custkey % 40) + CASE WHEN o_custkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS lmm FROM orders WHERE o_orderkey % 2 = 1)"""


@query(
    "secondary_records",
    f"""WITH part AS ({_part("0", "o_orderkey", "o_custkey", _MM, "true")} UNION ALL {_part("1", "(o_orderkey + 1)", "(o_custkey + 1)", "'-'", "true")}
      UNION ALL SELECT o_orderkey, 2, 'false:-:-:-:-:-:-' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 11 = 0
      UNION ALL SELECT o_orderkey, 3, 'false:-:-:-:-:-:-' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 13 = 0),
    l AS (SELECT case_id, string_agg(part, ';' ORDER BY pos) AS lesions FROM part GROUP BY 1), {FREE_SQL}
    SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'STRUCTURED' ELSE 'FREE_TEXT' END AS report_style, coalesce(lesions, '') AS lesions, cue, ls AS largest_side, lz AS largest_zone, lmm AS largest_mm,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END AS stated FROM orders LEFT JOIN l ON l.case_id = o_orderkey LEFT JOIN free f ON f.case_id = o_orderkey""",
)
def _(spark, folder):
    free = F.col("report_style") == "FREE_TEXT"
    only = lambda c: F.when(free, F.col(f"free.{c}")).alias(c)
    return secondary(spark, folder).select(
        "case_id", "report_style", told(F.col("lesions"), "parsed", "side", "zone", "zone_inferred", "anomaly", "note", "size_mm").alias("lesions"),
        F.col("free.laterality_cue").alias("cue"), *map(only, ("largest_side", "largest_zone", "largest_mm")), "stated",
    )


def rules(spark, folder):
    """Adjudications of the labelled documents: some exchange sides, some force a laterality, some declare a conflict."""
    doc, flip = F.col("doc_id"), F.create_map(F.lit("RIGHT"), F.lit("LEFT"), F.lit("LEFT"), F.lit("RIGHT"))
    conflict = F.struct(F.lit("laterality").alias("field"), F.array(F.lit("RIGHT")).alias("primary"), F.lit("BILATERAL").alias("secondary"))
    return table(spark, folder, "labels").select(
        doc.alias("case_id"), F.when(F.col("quality") == 0, flip).alias("flip_sides"), F.when(doc % 3 == 0, "BILATERAL").alias("force_laterality"),
        F.lit("IMAGE_REVIEW").alias("method"), F.concat(F.lit("case "), doc.cast("string")).alias("evidence"), F.when(doc % 2 == 0, conflict).alias("conflict"),
    )


CASE_SQL = f"""{PRIMARY_SQL}, {FREE_SQL},
  base AS (SELECT o_orderkey AS case_id, o_orderpriority AS site, p.case_id IS NOT NULL AS has_p, coalesce(p.declared, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 END) AS declared,
      CASE WHEN p.declared IS NULL AND o_orderkey % 3 = 0 THEN 'EXACT' ELSE coalesce(p.qualifier, 'UNKNOWN') END AS qualifier, p.age_years, coalesce(p.sex, 'UNKNOWN') AS sex, c.anomalies, c.notes,
      f.cue, f.ambiguous, f.ls, f.lz, f.lmm, l.doc_id IS NOT NULL AS ruled, coalesce(l.quality = 0, false) AS flips, l.doc_id % 3 = 0 AS forced, l.doc_id % 2 = 0 AS declares,
      NOT EXISTS (SELECT 1 FROM p_stone s WHERE s.case_id = o_orderkey) AND coalesce(f.lmm <> 0, false) AS borrowed
    FROM orders LEFT JOIN p_rec p ON p.case_id = o_orderkey LEFT JOIN p_cells c ON c.case_id = o_orderkey LEFT JOIN free f ON f.case_id = o_orderkey LEFT JOIN labels l ON l.doc_id = o_orderkey),
  every AS (SELECT case_id, i, side, zone, inferred, mm, cls, source FROM p_stone UNION ALL
    SELECT case_id, 1, ls, lz, true, lmm, {SIZE_CASE.format(x="lmm")}, 'free_text' FROM base WHERE borrowed),
  turned AS (SELECT e.*, CASE WHEN b.flips AND side = 'RIGHT' THEN 'LEFT' WHEN b.flips AND side = 'LEFT' THEN 'RIGHT' ELSE side END AS now FROM every e JOIN base b ON b.case_id = e.case_id),
  rolled AS (SELECT case_id, count(*) AS listed, {_stones("now")} AS stones, bool_or(side = 'RIGHT') AS r0, bool_or(side = 'LEFT') AS l0, bool_or(now = 'RIGHT') AS r, bool_or(now = 'LEFT') AS l FROM turned GROUP BY 1),
  j AS (SELECT b.*, coalesce(listed, 0) AS listed, coalesce(stones, '') AS stones, coalesce(r0, false) AS r0, coalesce(l0, false) AS l0, coalesce(r, false) OR coalesce(cue = 'RIGHT', false) AS r, coalesce(l, false) OR coalesce(cue = 'LEFT', false) AS l
    FROM base b LEFT JOIN rolled ON rolled.case_id = b.case_id),
  k AS (SELECT *, coalesce((r0 OR l0) AND ((cue = 'RIGHT' AND NOT r0) OR (cue = 'LEFT' AND NOT l0)), false) AS found, CASE WHEN qualifier <> 'MANY' THEN greatest(coalesce(declared, listed), listed) END AS ne FROM j)"""


@query(
    "case_records",
    f"""WITH {CASE_SQL} SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'STRUCTURED' ELSE 'FREE_TEXT' END AS report_style, age_years, sex, declared::BIGINT AS stone_count_declared, listed::BIGINT AS stone_count_listed,
      qualifier AS count_qualifier, coalesce(qualifier = 'EXACT' AND declared <> listed, false) AS count_mismatch, ne::BIGINT AS n_stones_effective,
      CASE WHEN ne IS NULL THEN 'MANY_UNSPECIFIED' WHEN ne <= 0 THEN '0' WHEN ne = 1 THEN '1' WHEN ne = 2 THEN '2' WHEN ne <= 4 THEN '3-4' WHEN ne <= 9 THEN '5-9' ELSE '10+' END AS count_bucket,
      CASE WHEN coalesce(forced, false) THEN 'BILATERAL' WHEN coalesce(cue, '') = 'BILATERAL' OR (r AND l) THEN 'BILATERAL' WHEN r THEN 'RIGHT' WHEN l THEN 'LEFT' ELSE 'NONE' END AS laterality, stones,
      concat_ws(',', nullif(coalesce(anomalies, ''), ''), CASE WHEN site = '1-URGENT' THEN 'URETERAL_STONE_PRESENT' END) AS anomalies, coalesce(ambiguous, false) AS free_text_laterality_ambiguous,
      CASE WHEN found THEN 'stone_side:' || CASE WHEN r0 THEN 'RIGHT' ELSE 'LEFT' END || ':' || cue || ':' || ruled WHEN ruled AND declares THEN 'laterality:RIGHT:BILATERAL:true' ELSE '' END AS conflicts,
      CASE WHEN ruled THEN 'IMAGE_REVIEW case ' || case_id END AS adjudication, coalesce(notes, '') AS notes, 'Hasta: ' || case_id || chr(10) || 'No ' || case_id AS whole,
      concat_ws(',', CASE WHEN borrowed THEN 'BORROWED' END, CASE WHEN found THEN 'CONFLICT' END, CASE WHEN flips THEN 'FLIPPED' END, CASE WHEN forced THEN 'FORCED' END, CASE WHEN ruled AND declares AND NOT found THEN 'DECLARED' END) AS steps FROM k""",
)
def _(spark, folder):
    cases = fx.cases(spark, folder).select("case_id", F.when(F.col("site") == "1-URGENT", "ARSIV_URETER_TASI").otherwise(F.col("site")).alias("collection"))
    got = records.case_records(cases, primary(spark, folder), secondary(spark, folder), rules(spark, folder))
    return got.select(
        "case_id", "report_style", "age_years", "sex", "stone_count_declared", "stone_count_listed", "count_qualifier", "count_mismatch", "n_stones_effective", "count_bucket", "laterality",
        told(F.col("stones"), *STONE).alias("stones"), F.array_join("anomalies", ",").alias("anomalies"), "free_text_laterality_ambiguous",
        F.array_join(F.transform("conflicts", lambda c: F.concat_ws(":", c["field"], F.array_join(c["primary"], "+"), c["secondary"], c["resolved"].cast("string"))), ";").alias("conflicts"),
        F.concat_ws(" ", "adjudication.method", "adjudication.evidence").alias("adjudication"), F.array_join("notes", "|").alias("notes"),
        F.col("original_report.whole").alias("whole"), F.array_join("steps", ",").alias("steps"),
    ).withColumn("adjudication", F.nullif("adjudication", F.lit("")))
