"""Aggregations, selections, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.functions.scalars import size_class
from cohortine.operators import aggregates as agg
from cohortine.operators import facts, selection, sets
from cohortine.plans.registry import query
from cohortine.plans.rows import ORDER, SIZE_CASE, f6, kidneys, voxels
from cohortine.sources import fixtures as fx
from cohortine.sources.fixtures import with_views
from cohortine.sources.tables import table

DET = ("f_case", "f_stone", "f_kidney", "f_det")


def detections(spark, folder):
    return fx.detections(kidneys(spark, folder))


# ------------------------------------------------------------------ aggregations
@query(
    "folder_inventory",
    """WITH g AS (SELECT c_custkey AS folder FROM customer), f AS (SELECT user_id AS folder, count(*) AS n_files, count(DISTINCT event_id) AS n_unique,
        count(DISTINCT props) AS n_series, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1)
    SELECT folder, coalesce(n_files, 0) AS n_files, coalesce(n_unique, 0) AS n_unique, coalesce(n_series, 0) AS n_series, coalesce(kinds, '') AS kinds
    FROM g LEFT JOIN f USING (folder)""",
)
def _(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("folder"), "event_id", "props", F.col("event_type").alias("kinds"))
    groups = table(spark, folder, "customer").select(F.col("c_custkey").alias("folder"))
    return agg.group_inventory(e, groups, "folder", "event_id", "props", ["kinds"])


@query(
    "list_rollup",
    "SELECT user_id % 50 AS name_key, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1",
)
def _(spark, folder):
    e = table(spark, folder, "events")
    per = e.groupBy("user_id").agg(agg.joined_set("event_type").alias("kinds"))
    return agg.merge_lists(per.withColumn("name_key", F.col("user_id") % 50), "name_key", "kinds")


@query(
    "series_summary",
    with_views("f_axis", body="""WITH c AS (SELECT series, kind, count(*) AS n FROM f_axis GROUP BY ALL),
        m AS (SELECT series, kind AS mode_label FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, kind) = 1)
      SELECT series, count(*) AS n_files, count(DISTINCT event_id) AS n_slices, arg_min(kind, event_id) AS first_label,
        string_agg(DISTINCT kind, '|' ORDER BY kind) AS labels, round(median(value), 6) AS median_value, any_value(mode_label) AS mode_label
      FROM f_axis JOIN m USING (series) GROUP BY series"""),
)
def _(spark, folder):
    out = agg.series_summary(fx.axis(spark, folder), "series", "value", "kind", "kind", "event_id")
    return out.withColumn("median_value", f6(F.col("median_value")))


def seconds(spark, folder):
    return fx.axis(spark, folder).select("series", (F.col("position") / 1.0e6).alias("position"))


GAPS_SQL = """a AS (SELECT series, position / 1.0e6::DOUBLE AS position FROM f_axis),
    d AS (SELECT series, position - lag(position) OVER (PARTITION BY series ORDER BY position) AS gap FROM a),
    g AS (SELECT series, median(gap) AS median_gap, stddev_pop(gap) AS gap_std, max(gap) AS max_gap FROM d WHERE gap IS NOT NULL GROUP BY 1),
    e AS (SELECT series, count(*) AS n, max(position) - min(position) AS extent, count(*) - count(DISTINCT round(position, 3)) AS n_duplicates FROM a GROUP BY 1)"""


@query(
    "gap_stats",
    with_views("f_axis", body=f"""WITH {GAPS_SQL} SELECT series, n, n_duplicates, round(extent, 3) AS extent, round(median_gap, 3) AS median_gap, round(gap_std, 3) AS gap_std,
      round(max_gap, 3) AS max_gap, coalesce(gap_std > 0.01, false) AS irregular, coalesce(max_gap > 2 * median_gap, false) AS has_gap FROM e LEFT JOIN g USING (series)"""),
)
def _(spark, folder):
    g = agg.gap_stats(seconds(spark, folder), "series", "position")
    for c in ("extent", "median_gap", "gap_std", "max_gap"):
        g = g.withColumn(c, F.round(c, 3))
    return g


@query(
    "value_counts",
    with_views("f_stone", body="SELECT size_class, zone, count(*) AS n FROM f_stone GROUP BY ALL"),
)
def _(spark, folder):
    return fx.stones(spark, folder).groupBy("size_class", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(
    "confusion_matrix",
    with_views(*DET, body="""WITH c AS (SELECT y, CAST(p >= 0.5 AS INTEGER) AS yhat, count(*) AS n FROM f_det GROUP BY ALL)
      SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y)::DOUBLE, 6) AS row_share FROM c"""),
)
def _(spark, folder):
    d = detections(spark, folder).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return agg.confusion(d, "y", "yhat").withColumn("row_share", f6(F.col("row_share")))


@query(
    "group_rollup",
    with_views(*DET, body="SELECT patient_id, seed, max(y) AS y, max(p) AS p FROM f_det GROUP BY ALL"),
)
def _(spark, folder):
    return detections(spark, folder).groupBy("patient_id", "seed").agg(F.max("y").alias("y"), F.max("p").alias("p"))


@query(
    "rate_by_stratum",
    with_views(*DET, body="""SELECT CASE WHEN y = 0 THEN 'no reported stone' WHEN max_mm IS NULL THEN 'size not recorded' WHEN max_mm < 4 THEN '≤3 mm' WHEN max_mm < 6 THEN '4–5 mm'
        WHEN max_mm < 11 THEN '6–10 mm' WHEN max_mm < 20 THEN '11–19 mm' ELSE '≥20 mm' END AS stratum,
      CASE WHEN y = 1 THEN 'sensitivity' ELSE 'specificity' END AS kind, count(DISTINCT kidney_id) AS n_kidneys, count(*) AS n_run,
      round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM f_det GROUP BY ALL"""),
)
def _(spark, folder):
    from cohortine.operators.evaluation import detection_strata

    out = detection_strata(detections(spark, folder))
    return out.withColumn("rate", f6(F.col("rate")))


@query(
    "case_rollup",
    with_views("f_stone", body=f"""SELECT *, {SIZE_CASE.format(x="max_mm")} AS max_class FROM (SELECT case_id, count(*) AS n_stones, max(seen_mm) AS max_mm,
      min(seen_mm) AS min_mm, round(sum(seen_mm), 1) AS sum_mm FROM f_stone GROUP BY case_id)"""),
)
def _(spark, folder):
    return agg.case_rollup(fx.stones(spark, folder), "seen_mm")


@query(
    "side_melt",
    with_views("f_case", "f_stone", body="""SELECT case_id, v.side, count(s.side) > 0 AS has_stone, count(s.side) AS n_characterized, max(s.size_mm) AS max_mm
      FROM f_case CROSS JOIN (VALUES ('RIGHT'), ('LEFT')) v(side) LEFT JOIN f_stone s USING (case_id, side) GROUP BY ALL"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder)
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = s.groupBy("case_id").agg(
        F.count_if(F.col("side") == "RIGHT").alias("right_n"), one("RIGHT", "size_mm").alias("right_mm"),
        F.count_if(F.col("side") == "LEFT").alias("left_n"), one("LEFT", "size_mm").alias("left_mm"),
    )
    full = fx.cases(spark, folder).select("case_id").join(wide, "case_id", "left")
    melted = full.select(
        "case_id",
        F.stack(F.lit(2), F.lit("RIGHT"), F.col("right_n"), F.col("right_mm"), F.lit("LEFT"), F.col("left_n"), F.col("left_mm")).alias("side", "n", "max_mm"),
    )
    n = F.coalesce("n", F.lit(0))
    return melted.select("case_id", "side", (n > 0).alias("has_stone"), n.alias("n_characterized"), "max_mm")


@query(
    "explode_stones",
    """SELECT o_orderkey AS case_id, 0 AS pos, o_orderkey % 9 AS code, (o_orderkey % 50 + 1)::DOUBLE AS size_mm FROM orders WHERE o_orderkey % 4 > 0
      UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END, o_custkey % 7, (o_custkey % 30 + 1)::DOUBLE FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(spark, folder):
    o = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    stone = lambda rule, code, mm: F.when(
        rule, F.struct(code.alias("code"), (mm + 1).cast("double").alias("size_mm"))
    )
    docs = o.select(
        key.alias("case_id"),
        F.array_compact(F.array(stone(key % 4 > 0, key % 9, key % 50), stone(key % 3 == 0, cust % 7, cust % 30))).alias("stones"),
    )
    return docs.select("case_id", F.posexplode("stones").alias("pos", "s")).select("case_id", "pos", "s.code", "s.size_mm")


@query(
    "mean_proba_argmax",
    """WITH p AS (SELECT vec_id % 100 AS unit, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      m AS (SELECT unit, pos, avg(x) AS m FROM p GROUP BY ALL)
    SELECT unit, CAST(arg_max(pos, m) AS INTEGER) AS argmax, round(max(m), 6) AS top FROM m GROUP BY unit""",
)
def _(spark, folder):
    e = table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 100).alias("unit"), F.col("embedding").cast("array<double>").alias("prob")
    )
    return agg.mean_vector_argmax(e, "unit", "prob").withColumn("top", f6(F.col("top")))


@query(
    "saturation_share",
    """WITH v AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) % 4096 - 1000 AS hu FROM lineitem),
      w AS (SELECT * FROM (VALUES ('soft', 40, 400), ('stone', 400, 1500), ('wide', 500, 3000)) t(win, wl, ww)),
      f AS (SELECT win, hu, round_even(255 * least(greatest((hu - (wl - ww / 2.0::DOUBLE)) / ww::DOUBLE, 0), 1), 0) = 255 AS sat FROM v, w)
    SELECT win AS window, round(count(*) FILTER (sat AND hu >= 200) / count(*) FILTER (hu >= 200)::DOUBLE, 6) AS stone_voxel_saturation,
      round(count(*) FILTER (sat AND hu > -500) / count(*) FILTER (hu > -500)::DOUBLE, 6) AS body_saturation FROM f GROUP BY win""",
)
def _(spark, folder):
    s = agg.saturation(voxels(spark, folder), "hu")
    return s.select("window", f6(F.col("stone_voxel_saturation")).alias("stone_voxel_saturation"), f6(F.col("body_saturation")).alias("body_saturation"))


@query(
    "bbox_stats",
    """WITH g AS (SELECT l_orderkey AS case_id, min(l_partkey) AS r0, max(l_partkey) + 1 AS r1, min(l_suppkey) AS c0, max(l_suppkey) + 1 AS c1,
        min(l_linenumber) AS s0, max(l_linenumber) + 1 AS s1, round(avg(l_partkey), 1) AS centroid_r, round(avg(l_suppkey), 1) AS centroid_c,
        round(avg(l_linenumber), 1) AS centroid_s, round(count(*) * 1.5::DOUBLE, 1) AS volume_mm3 FROM lineitem GROUP BY 1)
    SELECT *, round((s1 - 1) * 2.0::DOUBLE - s0 * 2.0::DOUBLE, 1) AS z_extent_mm, round(s0 * 2.0::DOUBLE + ((s1 - 1) * 2.0::DOUBLE - s0 * 2.0::DOUBLE) / 3, 2) AS lower_end_mm,
      round(s0 * 2.0::DOUBLE + 2 * (((s1 - 1) * 2.0::DOUBLE - s0 * 2.0::DOUBLE) / 3), 2) AS mid_end_mm FROM g""",
)
def _(spark, folder):
    s = fx.stones(spark, folder)
    return agg.point_geometry(s, ["case_id"], "part", "supp", "line", (1.0, 0.75, 2.0))


@query(
    "cohort_flow",
    with_views("f_case", "f_stone", "f_kidney", body="""WITH fe AS (SELECT patient_id, arg_min(case_id, (study_date, case_id)) AS first_case FROM f_case GROUP BY 1),
        k AS (SELECT f_kidney.*, case_id = first_case AS pe FROM f_kidney JOIN fe USING (patient_id))
      SELECT count(DISTINCT patient_id) AS n_patients, count(DISTINCT case_id) AS n_exams, count(*) AS n_kidneys_all, count(*) FILTER (pe) AS n_kidneys,
        count(*) FILTER (pe AND has_stone) AS n_positive, count(*) FILTER (pe AND NOT has_stone) AS n_negative,
        count(*) FILTER (pe AND has_stone AND max_class IS NOT NULL) AS n_size, count(*) FILTER (pe AND has_stone AND (zone_upper OR zone_mid OR zone_lower)) AS n_zone FROM k"""),
)
def _(spark, folder):
    exams = selection.first_exam(fx.cases(spark, folder))
    rolled = facts.kidney_table(exams, fx.stones(spark, folder), "zone5", "seen_mm", ORDER)
    pe, has = F.col("primary_exam"), F.col("has_stone")
    zone = F.col("zone_upper") | F.col("zone_mid") | F.col("zone_lower")
    return rolled.agg(
        F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("case_id").alias("n_exams"),
        F.count(F.lit(1)).alias("n_kidneys_all"), F.count_if(pe).alias("n_kidneys"), F.count_if(pe & has).alias("n_positive"),
        F.count_if(pe & ~has).alias("n_negative"), F.count_if(pe & has & F.col("max_class").isNotNull()).alias("n_size"),
        F.count_if(pe & has & zone).alias("n_zone"),
    )


@query(
    "recall_by_class",
    with_views(*DET, body="""SELECT max_class, count(*) FILTER (p >= 0.5) AS n_hit, count(*) AS n, round(count(*) FILTER (p >= 0.5) / count(*)::DOUBLE, 6) AS rate,
      CAST(list_position(['MIKROLITIYAZIS', 'KUCUK', 'ORTA', 'BUYUK', 'COK_BUYUK'], max_class) AS INTEGER) AS rank FROM f_det WHERE max_class IS NOT NULL GROUP BY max_class"""),
)
def _(spark, folder):
    d = detections(spark, folder).withColumn("hit", F.col("p") >= 0.5)
    return agg.rate_by_class(d, "max_class", "hit", V.SIZE_CLASSES).withColumn("rate", f6(F.col("rate")))


@query(
    "lse_pool",
    with_views("f_bag", body="""WITH m AS (SELECT bag, max(4 * logit) AS m FROM f_bag GROUP BY bag)
      SELECT bag, count(*) AS n, round((any_value(m) + ln(sum(exp(4 * logit - m))) - ln(count(*))) / 4, 6) AS pooled FROM f_bag JOIN m USING (bag) GROUP BY bag"""),
)
def _(spark, folder):
    return agg.lse_pool(fx.bags(spark, folder), ["bag"], "logit").withColumn("pooled", f6(F.col("pooled")))


# ------------------------------------------------------------------ selections
@query(
    "dedup_keep_largest",
    with_views("f_dup", body="""SELECT key, size, doc_id, source, lang, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n_copies,
      row_number() OVER (PARTITION BY key ORDER BY size DESC, doc_id) AS rn FROM f_dup) WHERE rn = 1"""),
)
def _(spark, folder):
    return selection.keep_largest(fx.duplicates(spark, folder), "key", "size", "doc_id")


def series_rows(spark, folder):
    s = fx.stones(spark, folder)
    return s.select(
        "case_id", F.concat_ws("-", "line", "part", "supp", "price").alias("series_id"),
        fx.word_by(F.col("part") % 4, ["AXIAL", "AXIAL", "CORONAL", "SAGITTAL"]).alias("plane"),
        F.round(F.col("disc") * 50, 2).alias("thickness"), (F.col("supp") % 3 == 0).alias("is_original"),
        (F.col("line") * 10 + F.col("part") % 10).alias("n_slices"),
    )


@query(
    "select_roles",
    with_views("f_stone", body="""WITH s AS (SELECT case_id, concat_ws('-', line, part, supp, price) AS id, CASE part % 4 WHEN 2 THEN 'CORONAL' WHEN 3 THEN 'SAGITTAL' ELSE 'AXIAL' END AS plane,
        round(disc * 50, 2) AS th, supp % 3 = 0 AS orig, line * 10 + part % 10 AS n FROM f_stone),
      a AS (SELECT *, CASE WHEN th BETWEEN 2.0 AND 3.5 THEN 0 WHEN th <= 1.25 THEN 1 ELSE 2 END AS tier FROM s WHERE plane = 'AXIAL'),
      m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY tier, orig DESC, n DESC, id) = 1),
      t AS (SELECT * FROM a WHERE th <= 1.25 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY orig DESC, n DESC, id) = 1),
      o AS (SELECT * FROM s WHERE plane <> 'AXIAL' QUALIFY row_number() OVER (PARTITION BY case_id, plane ORDER BY orig DESC, n DESC, id) = 1)
    SELECT case_id, 'axial_std' AS role, id AS series_id, CASE tier WHEN 0 THEN '2.0-3.5mm axial, ORIGINAL preferred, most slices'
      WHEN 1 THEN 'fallback: thin axial (no 2.5mm series)' ELSE 'fallback: any axial' END AS selection_reason FROM m
    UNION ALL SELECT t.case_id, 'axial_thin', t.id, '<=1.25mm axial, most slices' FROM t JOIN m USING (case_id) WHERE t.id <> m.id
    UNION ALL SELECT case_id, lower(plane) || '_native', id, lower(plane) || ' reformat with most slices' FROM o"""),
)
def _(spark, folder):
    return selection.select_roles(series_rows(spark, folder))


@query(
    "resolve_studies",
    """WITH s AS (SELECT o_custkey AS patient_id, o_orderkey AS study, strftime(o_orderdate, '%Y%m%d') AS study_date, o_orderpriority AS collection,
        CAST(o_totalprice AS BIGINT) AS n_slices FROM orders),
      r AS (SELECT c_custkey AS patient_id, CASE c_custkey % 4 WHEN 1 THEN 'URGENT' ELSE 'LOW' END AS wanted, c_custkey % 8 = 1 AS verified FROM customer WHERE c_custkey % 4 IN (1, 2)),
      j AS (SELECT s.*, wanted, coalesce(verified, false) AS verified, count(*) OVER (PARTITION BY s.patient_id) = 1 AS single,
        row_number() OVER (PARTITION BY s.patient_id ORDER BY CASE WHEN contains(collection, wanted) THEN 0 ELSE 1 END, study_date, study) AS k1,
        row_number() OVER (PARTITION BY s.patient_id ORDER BY n_slices DESC, study_date, study) AS k2 FROM s LEFT JOIN r ON r.patient_id = s.patient_id)
    SELECT patient_id, study, study_date, collection, CASE WHEN single THEN 'SINGLE_STUDY' WHEN wanted IS NOT NULL THEN 'PREFER_COLLECTION' ELSE 'PREFER_LARGEST_AXIAL' END AS study_assignment,
      single OR verified AS verified FROM j WHERE CASE WHEN NOT single AND wanted IS NOT NULL THEN k1 = 1 ELSE k2 = 1 END""",
)
def _(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("study"), F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"),
        F.col("o_orderpriority").alias("collection"), F.bround("o_totalprice", 0).cast("bigint").alias("n_slices"),
    )
    c = F.col("c_custkey")
    rules = table(spark, folder, "customer").where((c % 4).isin(1, 2)).select(
        c.alias("patient_id"), F.when(c % 4 == 1, "URGENT").otherwise("LOW").alias("wanted"), (c % 8 == 1).alias("verified")
    )
    return selection.resolve_studies(o, rules)


@query(
    "primary_exam",
    with_views("f_case", body="""SELECT case_id, patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY study_date, case_id) = 1 AS primary_exam FROM f_case"""),
)
def _(spark, folder):
    return selection.first_exam(fx.cases(spark, folder)).select("case_id", "patient_id", "primary_exam")


def case_sizes(spark, folder):
    """Cases with the size and class of their largest finding."""
    rolled = fx.stones(spark, folder).groupBy("case_id").agg(F.max("seen_mm").alias("max_mm"))
    j = fx.cases(spark, folder).join(rolled, "case_id", "left")
    return j.withColumn("max_class", size_class(F.col("max_mm"))).withColumn("lat", F.when(F.col("case_id") % 3 > 0, F.col("site")))


@query(
    "patient_representative",
    with_views("f_case", "f_stone", body=f"""WITH r AS (SELECT case_id, max(seen_mm) AS mm FROM f_stone GROUP BY 1),
        j AS (SELECT f_case.*, mm, {SIZE_CASE.format(x="mm")} AS max_class, CASE WHEN case_id % 3 > 0 THEN site END AS lat FROM f_case LEFT JOIN r USING (case_id))
      SELECT patient_id, count(*) AS n_cases, first(lat ORDER BY mm DESC NULLS LAST, case_id) FILTER (lat IS NOT NULL) AS lat,
        first(max_class ORDER BY mm DESC NULLS LAST, case_id) FILTER (max_class IS NOT NULL) AS max_class FROM j GROUP BY patient_id"""),
)
def _(spark, folder):
    return selection.representative(case_sizes(spark, folder), "patient_id", "max_mm", "case_id", ["lat", "max_class"])


@query(
    "norm_position",
    with_views("f_axis", body="""SELECT series, event_id, row_number() OVER w - 1 AS index, round(CASE WHEN count(*) OVER (PARTITION BY series) <= 1 THEN 0.5
      ELSE (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY series) - 1)::DOUBLE END, 6) AS position FROM f_axis WINDOW w AS (PARTITION BY series ORDER BY position, event_id)"""),
)
def _(spark, folder):
    a = fx.axis(spark, folder).withColumnRenamed("position", "x")
    out = selection.normal_positions(a, "series", ["x", "event_id"], F.col("x"))
    return out.select("series", "event_id", "index", f6(F.col("position")).alias("position"))


@query(
    "stratified_sample",
    with_views("f_stone", body="""WITH b AS (SELECT case_id AS bag, stone_index - 1 AS pos FROM f_stone), n AS (SELECT bag, count(*) AS n FROM b GROUP BY bag),
        g AS (SELECT b.bag, pos, ((pos + 1) * 4 - 1) // n AS slot, sha256('1337|' || b.bag || '|' || pos) AS h FROM b JOIN n USING (bag) WHERE n > 4)
      SELECT bag, CAST(slot AS INTEGER) AS slot, arg_min(pos, h) AS pos FROM g GROUP BY bag, slot
      UNION ALL SELECT bag, CAST(k AS INTEGER), CAST(round_even(k * (n - 1) / 3.0::DOUBLE, 0) AS BIGINT) FROM n, range(4) t(k) WHERE n <= 4"""),
)
def _(spark, folder):
    s = fx.indexed_stones(spark, folder).select(F.col("case_id").alias("bag"), (F.col("stone_index") - 1).alias("pos"))
    return selection.stratified_positions(s, "bag", "pos", 4, V.SEEDS[0])


@query(
    "pseudonym_ids",
    """WITH k AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labeled' ELSE 'holdout_unlabeled' END AS grp, sha256('salt' || doc_id) AS h FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h) AS rn FROM k)
    SELECT doc_id, grp, CASE grp WHEN 'labeled' THEN 'KS' ELSE 'KU' END || CASE WHEN rn < 10000 THEN lpad(rn::VARCHAR, 4, '0') ELSE rn::VARCHAR END AS patient_id FROM n""",
)
def _(spark, folder):
    from cohortine.operators.joins import split_by_membership

    d = split_by_membership(
        table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id", ("labeled", "holdout_unlabeled")
    ).withColumnRenamed("group", "grp")
    return selection.pseudonyms(d, "doc_id", "grp", "salt", {"labeled": "KS", "holdout_unlabeled": "KU"})


@query(
    "best_margin",
    with_views("f_axis", body="""SELECT series, arg_max(event_id, (value, -event_id)) FILTER (rn = 1) AS best_item, max(value) FILTER (rn = 1) AS best_score,
      round(max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC, event_id) AS rn FROM f_axis) GROUP BY series"""),
)
def _(spark, folder):
    m = selection.best_and_margin(fx.axis(spark, folder), ["series"], "value", "event_id")
    return m.withColumn("margin", f6(F.col("margin")))


@query(
    "argmax_position",
    with_views("f_bag", body="""SELECT bag, count(*) AS n, round(first(pos ORDER BY logit DESC, pos) / greatest(count(*) - 1, 1)::DOUBLE, 6) AS z_hat FROM f_bag GROUP BY bag"""),
)
def _(spark, folder):
    z = selection.argmax_share(fx.bags(spark, folder), ["bag"], "pos", "logit")
    return z.withColumn("z_hat", f6(F.col("z_hat")))


@query(
    "subcase_suffix",
    with_views("f_case", body="""WITH c AS (SELECT *, count(*) OVER (PARTITION BY site, patient_id) AS n, row_number() OVER (PARTITION BY site, patient_id ORDER BY study_date, case_id) AS k FROM f_case)
      SELECT case_id, site, patient_id, CASE WHEN n = 2 THEN patient_id || '_' || chr((64 + k)::INTEGER) ELSE patient_id::VARCHAR END AS sub_id FROM c"""),
)
def _(spark, folder):
    c = fx.cases(spark, folder)
    out = selection.letter_suffix(c, ["study_date", "case_id"], F.col("study_date").cast("int"), ["site"])
    return out.select("case_id", "site", "patient_id", "sub_id")


@query(
    "top_per_class",
    with_views("f_stone", body="""SELECT size_class, id, price FROM (SELECT size_class, concat_ws('-', case_id, line, part, supp) AS id, price, row_number() OVER (PARTITION BY size_class
      ORDER BY zone <> 'MID', price DESC, concat_ws('-', case_id, line, part, supp)) AS rn FROM f_stone) WHERE rn = 1"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder).withColumn("id", F.concat_ws("-", "case_id", "line", "part", "supp"))
    return selection.best_per_class(s, "size_class", F.col("zone") == "MID", "price", "id")


@query("top_values", "SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, part LIMIT 9")
def _(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"))
    return selection.frequent_values(li, "part", 9)


def case_summary(spark, folder):
    k = kidneys(spark, folder)
    return k.groupBy("case_id").agg(
        F.count_if("has_stone").alias("n_pos"), F.max("n_characterized").alias("max_char"),
        F.coalesce(F.max("max_mm"), F.lit(0.0)).alias("mm"), (F.max("case_id") % 10 == 0).alias("discordant"),
    )


@query(
    "scenario_picks",
    with_views("f_case", "f_stone", "f_kidney", body="""WITH c AS (SELECT case_id, count(*) FILTER (has_stone) AS n_pos, max(n_characterized) AS mc, coalesce(max(max_mm), 0) AS mm, case_id % 10 = 0 AS d FROM f_kidney GROUP BY case_id),
        p1 AS (SELECT case_id FROM c WHERE n_pos = 1 AND mc = 1 AND NOT d ORDER BY mm DESC, case_id LIMIT 1), p2 AS (SELECT case_id FROM c WHERE n_pos = 2 AND NOT d ORDER BY mm DESC, case_id LIMIT 1),
        p3 AS (SELECT case_id FROM c WHERE n_pos = 2 AND NOT d ORDER BY mm DESC, case_id LIMIT 1), p4 AS (SELECT case_id FROM c WHERE d ORDER BY mm DESC, case_id LIMIT 1)
      SELECT 1 AS scenario, 'unilateral single stone' AS label, case_id, false AS nearest_available FROM p1
      UNION ALL SELECT 2, 'bilateral disease', case_id, false FROM p2
      UNION ALL SELECT 3, 'bilateral disease again', (SELECT min(case_id) FROM c WHERE case_id NOT IN (SELECT case_id FROM p1) AND case_id NOT IN (SELECT case_id FROM p2)), true FROM p3
      UNION ALL SELECT 4, 'model–label discordance', case_id, false FROM p4"""),
)
def _(spark, folder):
    ok = ~F.col("discordant")
    two = (F.col("n_pos") == 2) & ok
    return selection.scenario_picks(
        case_summary(spark, folder),
        "case_id",
        [
            ("unilateral single stone", (F.col("n_pos") == 1) & (F.col("max_char") == 1) & ok, F.col("mm")),
            ("bilateral disease", two, F.col("mm")),
            ("bilateral disease again", two, F.col("mm")),
            ("model–label discordance", F.col("discordant"), F.col("mm")),
        ],
    )


@query(
    "seeded_sample",
    """SELECT lang, doc_id, draw FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('1337|' || doc_id)) AS draw FROM documents) WHERE draw <= 20""",
)
def _(spark, folder):
    return selection.seeded_sample(table(spark, folder, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, V.SEEDS[0])


# ------------------------------------------------------------------ sets
@query(
    "union_runs",
    with_views("f_run", body="""SELECT config, seed, fold, round(metric, 6) AS auc, NULL::DOUBLE AS qwk FROM f_run WHERE seed < 2
      UNION ALL SELECT config, seed, fold, NULL, round(base, 6) FROM f_run WHERE seed >= 2"""),
)
def _(spark, folder):
    r = fx.runs(spark, folder)
    a = r.where("seed < 2").select("config", "seed", "fold", f6(F.col("metric")).alias("auc"))
    b = r.where("seed >= 2").select("config", "seed", "fold", f6(F.col("base")).alias("qwk"))
    return sets.union_by_name([a, b])


@query(
    "key_set_ops",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_left_only,
      (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_right_only, NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS equal""",
)
def _(spark, folder):
    a = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey")
    b = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return sets.key_set_sizes(a, b)


def odd_even(spark, folder):
    s = fx.stones(spark, folder).select("case_id", "side", "zone", "size_class", "line")
    return s.where("line % 2 = 0").drop("line"), s.where("line % 2 = 1").drop("line")


@query(
    "multiset_match",
    with_views("f_stone", body="""WITH c AS (SELECT case_id, side, zone, size_class, count(*) FILTER (line % 2 = 0) AS g, count(*) FILTER (line % 2 = 1) AS t FROM f_stone GROUP BY ALL)
      SELECT case_id, side, zone, size_class, g AS n_guess, t AS n_truth, least(g, t) AS tp, g - least(g, t) AS fp, t - least(g, t) AS fn FROM c"""),
)
def _(spark, folder):
    guess, truth = odd_even(spark, folder)
    return sets.multiset_counts(guess, truth, ["case_id", "side", "zone", "size_class"])
