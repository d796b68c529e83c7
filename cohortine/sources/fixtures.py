"""Cohort-shaped views over the given tables, once for Spark and once as SQL.

``VIEWS_SQL`` holds the same definitions for the engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortine.functions.scalars import epoch_micros, size_class
from cohortine.operators.ordering import number_rows
from cohortine.sources.tables import table

SIDE = "RIGHT", "LEFT"


def word_by(index: Column, words: list[str]) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("patient_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"),
        F.col("o_orderpriority").alias("site"),
    )


def stones(spark: SparkSession, folder: str) -> DataFrame:
    """Findings without a running index; size is unknown where the tax is zero."""
    li = table(spark, folder, "lineitem")
    side = F.when(F.col("l_suppkey") % 2 == 0, "RIGHT").otherwise("LEFT")
    mm = F.col("l_quantity")
    observed = F.when(F.col("l_tax") > 0, mm)
    return li.select(
        F.col("l_orderkey").alias("case_id"),
        side.alias("side"),
        word_by(F.col("l_partkey") % 3, ["LOWER", "MID", "UPPER"]).alias("zone"),
        word_by(
            F.col("l_partkey") % 5, ["LOWER", "MID", "UPPER", "MID_UPPER", "MID_LOWER"]
        ).alias("zone5"),
        mm.alias("size_mm"),
        size_class(mm).alias("size_class"),
        observed.alias("seen_mm"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_shipdate").alias("ship"),
    )


def indexed_stones(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with their running index inside the case."""
    return number_rows(
        stones(spark, folder),
        ["case_id"],
        [F.col(c) for c in ("line", "part", "supp", "price", "ship")],
        F.col("line") * 1.0e9 + F.col("part"),
        "stone_index",
    )


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Units with a binary label and a score with ties."""
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("unit"),
        F.col("source").alias("grp"),
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("y2"),
        ((F.col("n_chars") % 97) / 97.0).alias("p"),
        ((F.col("n_chars") % 89) / 89.0).alias("p2"),
    )


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_type").alias("config"),
        (F.col("user_id") % 5).cast("int").alias("seed"),
        (F.dayofmonth("ts") % 5).cast("int").alias("fold"),
        "value",
        F.col("event_id").alias("event_id"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run table: 25 cells per configuration."""
    return run_rows(spark, folder).groupBy("config", "seed", "fold").agg(
        F.avg("value").alias("metric"),
        (F.avg(F.col("event_id") % 101) / 10.0).alias("base"),
        F.max("value").alias("peak"),
    )


def bags(spark: SparkSession, folder: str) -> DataFrame:
    """Positions and logits of every bag."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("bag"),
        (F.col("label") % 3).cast("int").alias("cls"),
        F.posexplode("embedding").alias("pos", "x"),
    ).select("bag", "cls", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("logit"))


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        F.md5(F.col("text").cast("binary")).alias("key"),
        F.col("n_chars").alias("size"),
        "doc_id",
        "source",
        "lang",
    )


def axis(spark: SparkSession, folder: str) -> DataFrame:
    """Positions along an axis, in microseconds, per series."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("series"),
        epoch_micros(F.col("ts")).alias("position"),
        F.col("event_type").alias("kind"),
        F.round("value", 2).alias("value"),
        "event_id",
    )


VIEWS_SQL = {
    "f_case": """f_case AS (SELECT o_orderkey AS case_id, o_custkey AS patient_id,
        strftime(o_orderdate, '%Y%m%d') AS study_date, o_orderpriority AS site FROM orders)""",
    "f_stone": """f_stone AS (SELECT l_orderkey AS case_id,
        CASE WHEN l_suppkey % 2 = 0 THEN 'RIGHT' ELSE 'LEFT' END AS side,
        CASE l_partkey % 3 WHEN 0 THEN 'LOWER' WHEN 1 THEN 'MID' ELSE 'UPPER' END AS zone,
        CASE l_partkey % 5 WHEN 0 THEN 'LOWER' WHEN 1 THEN 'MID' WHEN 2 THEN 'UPPER'
             WHEN 3 THEN 'MID_UPPER' ELSE 'MID_LOWER' END AS zone5,
        l_quantity AS size_mm,
        CASE WHEN l_quantity < 4 THEN 'MIKROLITIYAZIS' WHEN l_quantity < 6 THEN 'KUCUK'
             WHEN l_quantity < 11 THEN 'ORTA' WHEN l_quantity < 20 THEN 'BUYUK'
             ELSE 'COK_BUYUK' END AS size_class,
        CASE WHEN l_tax > 0 THEN l_quantity END AS seen_mm,
        l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
        l_discount AS disc, l_shipdate AS ship,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_shipdate) AS stone_index FROM lineitem)""",
    "f_pred": """f_pred AS (SELECT d.doc_id AS unit, d.source AS grp,
        CAST(quality AS INTEGER) AS y, CAST(toxic AS INTEGER) AS y2,
        (n_chars % 97) / 97.0::DOUBLE AS p, (n_chars % 89) / 89.0::DOUBLE AS p2
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "f_run": """f_run AS (SELECT event_type AS config, CAST(user_id % 5 AS INTEGER) AS seed,
        CAST(day(ts) % 5 AS INTEGER) AS fold, avg(value) AS metric,
        avg(event_id % 101) / 10.0 AS base, max(value) AS peak
        FROM events GROUP BY ALL)""",
    "f_bag": """f_bag AS (SELECT vec_id AS bag, CAST(label % 3 AS INTEGER) AS cls,
        CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
        CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)""",
    "f_dup": """f_dup AS (SELECT md5(text) AS key, n_chars AS size, doc_id, source, lang
        FROM documents)""",
    "f_axis": """f_axis AS (SELECT user_id AS series, epoch_us(ts) AS position,
        event_type AS kind, round(value, 2) AS value, event_id FROM events)""",
}


def with_views(*names: str, body: str) -> str:
    """SQL text with the named views in front."""
    parts = [VIEWS_SQL[n] for n in names]
    joined = ",\n".join(parts)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {joined},\n{text[5:]}"
    return f"WITH {joined}\n{text}"


ZONE_WORDS = [
    "ALT ZON",
    "ÜST ZON",
    "orta zon",
    "ORTA-ÜST ZON",
    "ORTA ALT ZON",
    "OR",
    "",
    "AT NALI BÖBREK MEVCUT",
    "ÇOK SAYIDA KÜÇÜK TAŞ, BÜYÜK TAŞ İZLENİMİ",
]


def zone_cell(part: Column, supp: Column) -> Column:
    """A zone cell as a radiologist types it, made from two keys."""
    words = word_by(part % 9, ZONE_WORDS)
    side = word_by(supp % 3, ["SAĞ ", "SOL ", "sağ "])
    return F.when(part % 9 >= 7, words).otherwise(F.concat(side, words))


def primary_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Wide label rows: three (zone, size) pairs, a count cell and a sex cell per case."""
    o = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("case_id"),
        cust.alias("patient_id"),
        zone_cell(key, cust).alias("zone_1"),
        F.when(key % 4 > 0, (key % 50 + 1).cast("double")).alias("mm_1"),
        F.when(key % 3 == 0, zone_cell(key + 4, cust + 1)).alias("zone_2"),
        F.when(key % 3 == 0, (cust % 30 + 1) / 2.0).alias("mm_2"),
        F.lit(None).cast("string").alias("zone_3"),
        F.when(key % 5 == 0, (cust % 40 + 1).cast("double")).alias("mm_3"),
        word_by(key % 7, ["çok sayıda", "1", "2", "3.0", "4", "?", "7"]).alias("count_raw"),
        word_by(cust % 4, ["E", "K", " k ", "x"]).alias("sex_raw"),
    )


VIEWS_SQL["f_kidney"] = """k_side AS (SELECT case_id, side, count(*) AS n, max(seen_mm) AS max_mm,
        bool_or(zone5 IN ('UPPER', 'MID_UPPER')) AS up,
        bool_or(zone5 IN ('MID', 'MID_UPPER', 'MID_LOWER')) AS mi,
        bool_or(zone5 IN ('LOWER', 'MID_LOWER')) AS lo FROM f_stone GROUP BY ALL),
    k_first AS (SELECT case_id, side, zone5 FROM f_stone QUALIFY row_number() OVER (
        PARTITION BY case_id, side ORDER BY seen_mm DESC NULLS LAST, stone_index) = 1),
    f_kidney AS (SELECT c.case_id, c.patient_id, c.study_date, v.side,
        k.n IS NOT NULL AS has_stone, coalesce(k.n, 0)::BIGINT AS n_characterized,
        k.max_mm AS max_mm,
        CASE WHEN k.max_mm IS NULL THEN NULL WHEN k.max_mm < 4 THEN 'MIKROLITIYAZIS'
             WHEN k.max_mm < 6 THEN 'KUCUK' WHEN k.max_mm < 11 THEN 'ORTA'
             WHEN k.max_mm < 20 THEN 'BUYUK' ELSE 'COK_BUYUK' END AS max_class,
        coalesce(k.up, false) AS zone_upper, coalesce(k.mi, false) AS zone_mid,
        coalesce(k.lo, false) AS zone_lower, coalesce(f.zone5, 'UNKNOWN') AS dominant_zone
        FROM f_case c CROSS JOIN (VALUES ('RIGHT'), ('LEFT')) v(side)
        LEFT JOIN k_side k ON k.case_id = c.case_id AND k.side = v.side
        LEFT JOIN k_first f ON f.case_id = c.case_id AND f.side = v.side)"""


def detections(kidneys: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """Seeded predictions per kidney: label, score, size class and position, some of them missing."""
    from cohortine.functions.scalars import size3

    seeds = seeds or [0, 1, 2, 3, 4]
    k = kidneys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    bit = F.when(F.col("side") == "RIGHT", 0).otherwise(1)
    mix = F.col("case_id") * 7919 + F.col("seed") * 104729 + bit * 31
    u = F.pmod(mix, F.lit(1000)) / 1000.0
    y = F.col("has_stone").cast("int")
    cls = F.when(F.pmod(mix, F.lit(5)) == 0, "MEDIUM").otherwise(size3(F.col("max_class")))
    zone = F.when(F.pmod(mix, F.lit(4)) == 0, "MID").otherwise(F.col("dominant_zone"))
    return k.select(
        F.concat(F.col("case_id").cast("string"), F.lit("_"), F.substring("side", 1, 1)).alias("kidney_id"),
        "case_id", "patient_id", "side", "seed", y.alias("y"),
        F.round(y * 0.35 + u * 0.65, 6).alias("p"),
        "max_mm", "max_class", "dominant_zone", "n_characterized", "has_stone",
        F.when(F.pmod(mix, F.lit(6)) > 0, cls).alias("size_cls"),
        F.when(zone != "UNKNOWN", zone).alias("zone"),
        F.round(u, 3).alias("z_hat"),
        (F.pmod(F.col("case_id"), F.lit(23)) > 0).alias("mask_plausible"),
    )


VIEWS_SQL["f_det"] = """d_mix AS (SELECT *, case_id * 7919 + seed * 104729 + CASE side WHEN 'RIGHT' THEN 0 ELSE 1 END * 31 AS mix
      FROM f_kidney CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS seed)),
    d_cls AS (SELECT *, CASE WHEN mix % 5 = 0 THEN 'MEDIUM' WHEN max_class IN ('MIKROLITIYAZIS', 'KUCUK') THEN 'SMALL' WHEN max_class = 'ORTA' THEN 'MEDIUM'
        WHEN max_class IN ('BUYUK', 'COK_BUYUK') THEN 'LARGE' END AS cls0, CASE WHEN mix % 4 = 0 THEN 'MID' ELSE dominant_zone END AS zone0 FROM d_mix),
    f_det AS (SELECT case_id || '_' || side[1] AS kidney_id, case_id, patient_id, side, seed::INTEGER AS seed, has_stone::INTEGER AS y,
      round(has_stone::INTEGER * 0.35::DOUBLE + (mix % 1000) / 1000.0::DOUBLE * 0.65::DOUBLE, 6) AS p, max_mm, max_class, dominant_zone, n_characterized, has_stone,
      CASE WHEN mix % 6 > 0 THEN cls0 END AS size_cls, CASE WHEN zone0 <> 'UNKNOWN' THEN zone0 END AS zone,
      round((mix % 1000) / 1000.0::DOUBLE, 3) AS z_hat, case_id % 23 > 0 AS mask_plausible FROM d_cls)"""


def report_stones(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the report records: five zones, half millimetres, some sizes unknown."""
    s = stones(spark, folder)
    mm = F.when(F.col("part") % 4 == 0, F.col("seen_mm") - 0.5).otherwise(F.col("seen_mm"))
    return s.select(
        "case_id", "side", F.col("zone5").alias("zone"), mm.alias("mm"), size_class(mm).alias("cls"),
        F.when(F.col("side") == "RIGHT", 0).otherwise(1).alias("side_rank"),
    )


def report_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per case: laterality with a cue, count with a qualifier, anomalies."""
    from cohortine.functions.labels import derive_laterality
    from cohortine.functions.scalars import effective_count

    rolled = stones(spark, folder).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("side") == "RIGHT").alias("r"), F.bool_or(F.col("side") == "LEFT").alias("l")
    )
    j = cases(spark, folder).join(rolled, "case_id", "left")
    k = F.col("case_id")
    cue = F.when(k % 7 == 0, "BILATERAL").when(k % 7 == 1, "RIGHT")
    listed = F.coalesce("n", F.lit(0))
    declared = F.when(k % 5 == 1, listed + 3)
    qualifier = F.when(k % 5 == 0, "MANY").otherwise("EXACT")
    notes = F.array_compact(
        F.array(
            F.when(k % 11 == 0, "HORSESHOE_KIDNEY"), F.when(k % 13 == 0, "MANY_SMALL_STONES_MIMIC_LARGE"),
            F.when(k % 17 == 0, "HYPERDENSE_PYRAMID_MIMIC"), F.when(k % 19 == 0, "COMPLICATED_CYST_HYPERDENSE_LESION"),
            F.when(k % 23 == 0, "URETERAL_STONE_PRESENT"), F.when(k % 29 == 0, "BLADDER_DIVERTICULUM_STONE"),
        )
    )
    return j.select(
        "case_id",
        derive_laterality(F.col("r"), F.col("l"), cue).alias("laterality"),
        F.nullif(effective_count(declared, listed, qualifier), F.lit(0)).alias("n_effective"),
        qualifier.alias("qualifier"),
        notes.alias("anomalies"),
    )


VIEWS_SQL["f_rec"] = """r_stone AS (SELECT case_id, side, zone5 AS zone, CASE WHEN part % 4 = 0 THEN seen_mm - 0.5 ELSE seen_mm END AS mm, CASE side WHEN 'RIGHT' THEN 0 ELSE 1 END AS srank FROM f_stone),
    r_cls AS (SELECT *, CASE WHEN mm IS NULL THEN NULL WHEN mm < 4 THEN 'MIKROLITIYAZIS' WHEN mm < 6 THEN 'KUCUK' WHEN mm < 11 THEN 'ORTA' WHEN mm < 20 THEN 'BUYUK' ELSE 'COK_BUYUK' END AS cls,
      CASE WHEN mm IS NULL THEN '' WHEN mm = floor(mm) THEN mm::BIGINT::VARCHAR ELSE mm::VARCHAR END AS mmt, row_number() OVER (PARTITION BY case_id, side ORDER BY mm DESC NULLS LAST, zone) AS rn, count(*) OVER (PARTITION BY case_id, side) AS ns FROM r_stone),
    r_side AS (SELECT case_id, side, count(*) AS n, max(mm) AS max_mm, any_value(cls) FILTER (rn = 1) AS max_cls, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones,
      string_agg(zone || ',' || mmt || ',' || coalesce(cls, '-'), ';' ORDER BY rn) AS stones FROM r_cls GROUP BY ALL),
    r_big AS (SELECT * FROM r_cls WHERE mm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY mm DESC, srank, zone) = 1),
    r_base AS (SELECT c.case_id, coalesce(r.n, 0) AS rn_, coalesce(l.n, 0) AS ln_, coalesce(r.n, 0) + coalesce(l.n, 0) AS n, c.case_id % 5 = 0 AS many,
      coalesce(r.n, 0) > 0 OR c.case_id % 7 = 1 AS hr, coalesce(l.n, 0) > 0 AS hl, c.case_id % 7 = 0 AS bil, coalesce(r.stones, '') AS right_stones, coalesce(l.stones, '') AS left_stones,
      r.max_mm AS right_max_mm, l.max_mm AS left_max_mm, r.max_cls AS right_max_cls, l.max_cls AS left_max_cls, coalesce(r.zones, '') AS right_zones, coalesce(l.zones, '') AS left_zones
      FROM f_case c LEFT JOIN r_side r ON r.case_id = c.case_id AND r.side = 'RIGHT' LEFT JOIN r_side l ON l.case_id = c.case_id AND l.side = 'LEFT'),
    f_rec AS (SELECT b.*, CASE WHEN bil OR (hr AND hl) THEN 'BILATERAL' WHEN hr THEN 'RIGHT' WHEN hl THEN 'LEFT' ELSE 'NONE' END AS laterality, hr OR bil AS right_present, hl OR bil AS left_present,
      CASE WHEN NOT many THEN nullif(CASE WHEN b.case_id % 5 = 1 THEN n + 3 ELSE n END, 0) END AS total_n, CASE WHEN many THEN 'MANY' ELSE 'EXACT' END AS total_qualifier,
      g.side AS big_side, g.zone AS big_zone, g.mmt AS big_mm, g.cls AS big_cls,
      concat_ws(',', CASE WHEN b.case_id % 29 = 0 THEN 'BLADDER_DIVERTICULUM_STONE' END, CASE WHEN b.case_id % 19 = 0 THEN 'COMPLICATED_CYST_HYPERDENSE_LESION' END, CASE WHEN b.case_id % 11 = 0 THEN 'HORSESHOE_KIDNEY' END,
        CASE WHEN b.case_id % 17 = 0 THEN 'HYPERDENSE_PYRAMID_MIMIC' END, CASE WHEN b.case_id % 13 = 0 THEN 'MANY_SMALL_STONES_MIMIC_LARGE' END, CASE WHEN b.case_id % 23 = 0 THEN 'URETERAL_STONE_PRESENT' END) AS anomalies
      FROM r_base b LEFT JOIN r_big g ON g.case_id = b.case_id),
    r_hash AS (SELECT *, substr(sha1(concat_ws('|', laterality, coalesce(total_n::VARCHAR, '-'), total_qualifier, n::VARCHAR, right_present::VARCHAR || ':' || right_stones, left_present::VARCHAR || ':' || left_stones, anomalies)), 1, 16) AS facts_hash FROM f_rec)"""
