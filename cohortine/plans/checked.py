"""Folds, quality checks and privacy scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.functions import labels, vocab as V
from cohortine.functions.names import capitals
from cohortine.functions.scalars import decode_offset, encode_offset
from cohortine.operators import aggregates as agg

from cohortine.operators import facts, folds, joins, linkage, quality, selection, terms
from cohortine.operators import reports as rep
from cohortine.plans.evaluated import rounded
from cohortine.plans.grouped import GAPS_SQL, seconds, series_rows
from cohortine.plans.joined import PLACES, linkage_tables
from cohortine.plans.registry import query
from cohortine.plans.reporting import REC, SEED, facts as report_facts
from cohortine.plans.rows import ORDER, f6, finding_text, voxels
from cohortine.sources import fixtures as fx
from cohortine.sources.fixtures import with_views
from cohortine.sources.tables import table

SEEDS = V.SEEDS


# ------------------------------------------------------------------ folds
def strata(spark, folder):
    """Patients with the stratum of their largest order."""
    o = table(spark, folder, "orders")
    tier = F.when(F.col("o_totalprice") < 280000, "S").when(F.col("o_totalprice") < 400000, "M").otherwise("L")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("parent"))
    cases = o.select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("size"),
        F.when(F.col("o_custkey") % 50 > 0, tier).alias("tier"),
    ).join(c, "patient_id", "left")
    return folds.patient_strata(cases, "size", "parent", "tier", "case_id")


STRATA_SQL = """b AS (SELECT o_custkey AS patient_id, count(*) AS n_cases, max(o_totalprice) AS m FROM orders GROUP BY 1),
    p AS (SELECT patient_id, n_cases, c_mktsegment AS parent, CASE WHEN patient_id % 50 = 0 THEN 'NA' WHEN m < 280000 THEN 'S' WHEN m < 400000 THEN 'M' ELSE 'L' END AS tier FROM b JOIN customer ON c_custkey = patient_id),
    s AS (SELECT *, parent || '|' || tier AS stratum FROM p)"""
MERGED_SQL = STRATA_SQL + """, z AS (SELECT stratum, parent, tier, count(*) AS n, min(patient_id) AS f, parent || '|' || CASE tier WHEN 'S' THEN 'M' WHEN 'M' THEN 'L' WHEN 'L' THEN 'M' END AS tgt FROM s GROUP BY ALL),
    m AS (SELECT z.stratum, z.parent, z.n, CASE WHEN z.n >= 5 THEN z.stratum WHEN t.n IS NOT NULL AND (t.n >= 5 OR t.n > z.n OR (t.n = z.n AND t.f > z.f)) THEN z.tgt ELSE z.parent END AS mg FROM z LEFT JOIN z t ON t.stratum = z.tgt),
    q AS (SELECT *, min(sz) OVER () < 5 AS thin FROM (SELECT *, sum(n) OVER (PARTITION BY mg) AS sz FROM m)),
    u AS (SELECT s.*, CASE WHEN thin THEN q.parent ELSE mg END AS stratum_used FROM s JOIN q ON q.stratum = s.stratum)"""
FOLDS_SQL = MERGED_SQL + """, w AS (SELECT stratum_used, coalesce(sum(n) OVER (ORDER BY stratum_used ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (SELECT stratum_used, count(*) AS n FROM u GROUP BY 1)),
    fo AS (SELECT u.patient_id, u.stratum_used, seed, CAST((row_number() OVER (PARTITION BY seed, u.stratum_used ORDER BY sha256(seed || '|' || u.patient_id)) - 1 + st) % 5 AS INTEGER) AS fold
      FROM u JOIN w ON w.stratum_used = u.stratum_used CROSS JOIN (SELECT unnest([1337, 2027, 7, 42, 12345]) AS seed))"""


def assigned(spark, folder):
    merged = folds.merge_thin(strata(spark, folder))
    return folds.stratified_folds(merged, "stratum_used", SEEDS)


@query("patient_stratum", f"WITH {STRATA_SQL} SELECT patient_id, n_cases, parent, tier, stratum FROM s")
def _(spark, folder):
    return strata(spark, folder)


@query("merge_thin_strata", f"WITH {MERGED_SQL} SELECT stratum, stratum_used, count(*) AS n FROM u GROUP BY ALL")
def _(spark, folder):
    return folds.merge_thin(strata(spark, folder)).groupBy("stratum", "stratum_used").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", f"WITH {FOLDS_SQL} SELECT patient_id, stratum_used, seed::INTEGER AS seed, fold FROM fo")
def _(spark, folder):
    return assigned(spark, folder)


@query(
    "fold_columns",
    f"""WITH {FOLDS_SQL}, c AS (SELECT patient_id, max(fold) FILTER (seed = 1337) AS cv5_seed1337, max(fold) FILTER (seed = 2027) AS cv5_seed2027, max(fold) FILTER (seed = 7) AS cv5_seed7,
      max(fold) FILTER (seed = 42) AS cv5_seed42, max(fold) FILTER (seed = 12345) AS cv5_seed12345 FROM fo GROUP BY 1)
    SELECT o_orderkey AS case_id, v.side, c.* FROM orders JOIN c ON c.patient_id = o_custkey CROSS JOIN (VALUES ('RIGHT'), ('LEFT')) v(side)""",
)
def _(spark, folder):
    wide = folds.fold_columns(assigned(spark, folder), SEEDS)
    cases = fx.cases(spark, folder).select("case_id", "patient_id")
    return facts.side_rows(cases).join(wide, "patient_id")


def fold_rows(spark, folder):
    """Case rows with the fold of their patient, per seed."""
    cases = fx.cases(spark, folder).select("case_id", "patient_id")
    return cases.join(assigned(spark, folder).select("patient_id", "seed", "fold"), "patient_id")


@query(
    "fold_split",
    f"""WITH {FOLDS_SQL}, r AS (SELECT seed, fold, o_custkey FROM fo JOIN orders ON o_custkey = patient_id)
    SELECT seed::INTEGER AS seed, t::INTEGER AS test_fold, CASE WHEN fold = t THEN 'test' WHEN fold = (t + 1) % 5 THEN 'val' ELSE 'train' END AS role, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients FROM r, range(5) x(t) GROUP BY ALL""",
)
def _(spark, folder):
    return folds.split_sizes(fold_rows(spark, folder))


@query(
    "leak_check",
    f"WITH {FOLDS_SQL} SELECT seed::INTEGER AS seed, count(DISTINCT patient_id) AS n_units, 0::BIGINT AS n_leaks FROM fo GROUP BY seed",
)
def _(spark, folder):
    return folds.leaks(fold_rows(spark, folder))


# ------------------------------------------------------------------ checks
def coverage_check(spark, folder):
    g = agg.gap_stats(seconds(spark, folder), "series", "position")
    low = F.count_if((F.col("n") < 55) | (F.col("extent") < 1000000))
    return quality.check(g, "coverage", low == 0, F.concat(F.count(F.lit(1)).cast("string"), F.lit(" series, "), low.cast("string"), F.lit(" below")))


COVERAGE_SQL = """SELECT 'coverage' AS name, count(*) FILTER (n < 55 OR extent < 1000000) = 0 AS ok, count(*) || ' series, ' || count(*) FILTER (n < 55 OR extent < 1000000) || ' below' AS detail FROM e"""


@query("qa_coverage", with_views("f_axis", body=f"WITH {GAPS_SQL} {COVERAGE_SQL}"))
def _(spark, folder):
    return coverage_check(spark, folder)


def geometry_check(spark, folder):
    g = agg.gap_stats(seconds(spark, folder), "series", "position")
    dup = F.count_if(F.col("n_duplicates") > 0)
    parts = [F.lit("duplicates="), dup.cast("string"), F.lit(", irregular="), F.count_if("irregular").cast("string"), F.lit(", gaps="), F.count_if("has_gap").cast("string")]
    return quality.check(g, "geometry", dup == 0, F.concat(*parts))


GEOMETRY_SQL = """SELECT 'geometry' AS name, count(*) FILTER (n_duplicates > 0) = 0 AS ok, 'duplicates=' || count(*) FILTER (n_duplicates > 0) || ', irregular=' || count(*) FILTER (gap_std > 0.01) || ', gaps=' || count(*) FILTER (max_gap > 2 * median_gap) AS detail FROM e LEFT JOIN g USING (series)"""


@query("qa_geometry", with_views("f_axis", body=f"WITH {GAPS_SQL} {GEOMETRY_SQL}"))
def _(spark, folder):
    return geometry_check(spark, folder)


def lesions(spark, folder):
    """Parts of the finding texts; equal texts are read once, ``n`` tells how many there are."""
    t = finding_text(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return labels.finding_rows(t, "text")


def times(rule):
    """The parts for which a rule holds, over all texts."""
    return F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0))


def golden(spark, folder):
    """Counts recovered from finding texts against the counts of the table they were written from."""
    from cohortine.functions.scalars import size_class

    parsed = lesions(spark, folder)
    cls = F.when(F.col("parsed") & F.col("size_mm").isNotNull(), size_class(F.col("size_mm")))
    kinds = F.explode(
        F.array_compact(
            F.array(F.lit("phrases"), F.when(~F.col("parsed"), "unparsed"), F.concat(F.lit("class "), cls))
        )
    ).alias("metric")
    actual = parsed.select(kinds, "n").groupBy("metric").agg(F.sum("n").alias("value"))
    s = fx.stones(spark, folder)
    truth = F.explode(
        F.array_compact(
            F.array(
                F.lit("phrases"), F.lit("phrases"), F.when(F.col("part") % 11 == 0, "phrases"), F.lit("rows"),
                F.concat(F.lit("class "), F.col("size_class")),
            )
        )
    ).alias("metric")
    return quality.against_expected(actual, s.select(truth).groupBy("metric").agg(F.count(F.lit(1)).alias("value")))


GOLDEN_SQL = """WITH a AS (SELECT 'phrases' AS metric, count(*) * 2 + count(*) FILTER (l_partkey % 11 = 0) AS v FROM lineitem UNION ALL SELECT 'unparsed', count(*) FROM lineitem WHERE l_partkey % 11 = 0
      UNION ALL SELECT 'class ' || CASE WHEN l_quantity < 4 THEN 'MIKROLITIYAZIS' WHEN l_quantity < 6 THEN 'KUCUK' WHEN l_quantity < 11 THEN 'ORTA' WHEN l_quantity < 20 THEN 'BUYUK' ELSE 'COK_BUYUK' END, count(*) FROM lineitem GROUP BY 1),
    e AS (SELECT metric, v FROM a WHERE metric <> 'unparsed' UNION ALL SELECT 'rows', count(*) FROM lineitem)
    SELECT coalesce(a.metric, e.metric) AS metric, a.v::BIGINT AS actual, e.v::BIGINT AS expected, a.v IS NOT DISTINCT FROM e.v AS ok FROM a FULL JOIN e ON a.metric = e.metric"""


@query("golden_numbers", GOLDEN_SQL)
def _(spark, folder):
    return golden(spark, folder)


def parse_check(spark, folder):
    p = lesions(spark, folder)
    bad, side, zone = times(~F.col("parsed")), times(F.col("side") == "UNKNOWN"), times(F.col("zone") == "UNKNOWN")
    parts = [F.lit("unparsed="), bad.cast("string"), F.lit(", side unknown="), side.cast("string"), F.lit(", zone unknown="), zone.cast("string")]
    return quality.check(p, "parse", (bad == 0) & (side == 0) & (zone == 0), F.concat(*parts))


PARSE_SQL = """SELECT 'parse' AS name, false AS ok, 'unparsed=' || count(*) FILTER (l_partkey % 11 = 0) || ', side unknown=' || (count(*) FILTER (l_partkey % 9 >= 7) + count(*) FILTER ((l_partkey + 1) % 9 >= 7)) ||
    ', zone unknown=' || (count(*) FILTER (l_partkey % 9 >= 6) + count(*) FILTER ((l_partkey + 1) % 9 >= 6)) AS detail FROM lineitem"""


@query("qa_parse", PARSE_SQL)
def _(spark, folder):
    return parse_check(spark, folder)


def linkage_check(spark, folder):
    tables = linkage_tables(spark, folder)
    linked = linkage.link_records(*tables)
    fired = linkage.alias_audit(*tables).agg(F.coalesce(F.bool_and("fired"), F.lit(True)).alias("f"))
    manual = F.count_if(F.col("method") == "MANUAL")
    n = F.count_if(F.col("group") == "labeled")
    detail = F.concat(F.lit("labeled="), n.cast("string"), F.lit(", manual="), manual.cast("string"))
    return quality.check(linked.withColumn("f", fired.scalar()), "linkage", (manual == 0) & F.bool_and("f"), detail)


LINKAGE_SQL = "SELECT 'linkage' AS name, true AS ok, 'labeled=' || count(*) FILTER (c_custkey % 7 <> 6) || ', manual=0' AS detail FROM customer"


@query("qa_linkage", LINKAGE_SQL)
def _(spark, folder):
    return linkage_check(spark, folder)


@query(
    "qa_lossless",
    with_views("f_bag", body="SELECT bag, count(*) + CASE WHEN bag % 40 = 0 THEN 1 ELSE 0 END AS n_tested, CASE WHEN bag % 50 = 0 THEN 1 ELSE 0 END + CASE WHEN bag % 40 = 0 THEN 1 ELSE 0 END::BIGINT AS n_mismatch FROM f_bag GROUP BY bag"),
)
def _(spark, folder):
    return lossless_cells(spark, folder)


def lossless_cells(spark, folder):
    b = fx.bags(spark, folder).withColumn("hu", F.floor(F.col("logit") * 1000).cast("bigint"))
    damage = F.when((F.col("bag") % 50 == 0) & (F.col("pos") == 3), 1).otherwise(0)
    stored = b.select("bag", "pos", (decode_offset(encode_offset(F.col("hu"))) + damage).cast("bigint").alias("hu"))
    extra = b.where("bag % 40 = 0 AND pos = 0").select("bag", (F.col("pos") + 1000).alias("pos"), "hu")
    return quality.mismatched_cells(b.select("bag", "pos", "hu").unionByName(extra), stored, ["bag", "pos"], "hu", "bag")


def sidecars(spark, folder):
    """Side files of suppliers; every third still names its supplier under a header tag."""
    s = table(spark, folder, "supplier")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"PatientName": "'), F.col("s_name"), F.lit('"}'))).otherwise(F.concat(F.lit('{"id": '), F.col("s_suppkey").cast("string"), F.lit("}")))
    return s.select(F.concat(F.lit("side/"), F.col("s_suppkey").cast("string")).alias("file"), text.alias("text"))


def phi_hits(spark, folder):
    """Every identifying term in texts and side files, and in the addresses of pages: file, kind, term, place."""
    names = table(spark, folder, "supplier").select(F.col("s_name").alias("value"))
    ids = table(spark, folder, "benchmark").select(F.col("text").alias("value"))
    words = terms.identifying_terms(names, ids, V.MIN_NAME_LENGTH, V.MIN_ID_LENGTH)
    tags = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in V.FORBIDDEN_TAGS])).alias("term"), F.lit("tag").alias("kind"))
    every = words.unionByName(tags).withColumn("term_id", F.lit(0))
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), "text")
    talks = table(spark, folder, "conversations").select(F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("file"), "text")
    inside = terms.scan_hits(docs.unionByName(talks).unionByName(sidecars(spark, folder)), "file", "text", every)
    hosts = table(spark, folder, "pages").select(capitals(F.regexp_extract("url", r"//([^.]+)\.", 1)).alias("term"))
    named = hosts.where(F.length("term") >= V.MIN_NAME_LENGTH).distinct().select(F.lit("filename").alias("kind"), "term", F.lit(0).alias("term_id"))
    paths = table(spark, folder, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.col("url").alias("text"))
    return inside.unionByName(terms.scan_hits(paths, "file", "text", named)).drop("term_id")


PHI_SQL = f"""WITH t AS (SELECT DISTINCT 'name' AS kind, trim(upper(s_name)) AS term FROM supplier UNION SELECT 'uid', trim(upper(text)) FROM benchmark
      UNION SELECT 'tag', unnest(['PATIENTNAME', 'PATIENTBIRTHDATE', 'ACCESSIONNUMBER', 'INSTITUTIONNAME'])),
    k AS (SELECT * FROM t WHERE kind = 'tag' OR (kind = 'name' AND length(term) > 6) OR (kind = 'uid' AND length(term) >= 20)),
    x AS (SELECT 'doc/' || doc_id AS file, upper(text) AS u FROM documents UNION ALL SELECT 'conv/' || conv_id || '/' || turn, upper(text) FROM conversations
      UNION ALL SELECT 'side/' || s_suppkey, upper(CASE WHEN s_suppkey % 3 = 0 THEN '{{"PatientName": "' || s_name || '"}}' ELSE '{{"id": ' || s_suppkey || '}}' END) FROM supplier),
    h AS (SELECT DISTINCT upper(regexp_extract(url, '//([^.]+)[.]', 1)) AS term FROM pages)
    SELECT file, kind, term, {PLACES.format(u="u", t="term")} AS place FROM x JOIN k ON contains(u, term)
    UNION ALL SELECT 'page/' || page_id, 'filename', term, {PLACES.format(u="upper(url)", t="term")} FROM pages JOIN h ON length(term) >= 7 AND contains(upper(url), term)"""


@query("phi_scan", PHI_SQL)
def _(spark, folder):
    return phi_hits(spark, folder)


PHI_CHECK_SQL = f"SELECT 'phi' AS name, count(*) = 0 AS ok, count(DISTINCT file || kind) || ' hits' AS detail FROM ({PHI_SQL})"


def phi_check(spark, folder):
    hits = phi_hits(spark, folder).select("file", "kind").distinct()
    return quality.check(hits, "phi", F.count(F.lit(1)) == 0, F.concat(F.count(F.lit(1)).cast("string"), F.lit(" hits")))


@query("qa_phi", PHI_CHECK_SQL)
def _(spark, folder):
    return phi_check(spark, folder)


@query(
    "schema_check",
    """SELECT event_id, k BETWEEN 0 AND 90 AND event_id % 100 <> 0 AS valid, CASE WHEN event_id % 100 = 0 THEN 'json|has_k|range' WHEN NOT k BETWEEN 0 AND 90 THEN 'range' ELSE '' END AS broken
    FROM (SELECT event_id, CAST(regexp_extract(props, '\\d+') AS INTEGER) AS k FROM events)""",
)
def _(spark, folder):
    return schema_rows(spark, folder)


def schema_rows(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props")).alias("text")
    )
    out = quality.required_fields(e, "text", "k INT", {"has_k": "doc.k IS NOT NULL", "range": "doc.k BETWEEN 0 AND 90"})
    return out.select("event_id", "valid", F.array_join("broken", "|").alias("broken"))


@query(
    "cohort_contract",
    with_views("f_case", body="""SELECT 'all' AS cohort, count(*) * 2 AS n_rows, count(DISTINCT patient_id) AS n_patients, count(*) AS n_cases, max(n) AS max_cases_per_patient, max(n) = 1 AS ok FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS n FROM f_case)
      UNION ALL SELECT 'primary', count(DISTINCT patient_id) * 2, count(DISTINCT patient_id), count(DISTINCT patient_id), 1, true FROM f_case"""),
)
def _(spark, folder):
    exams = selection.first_exam(fx.cases(spark, folder))
    every = facts.side_rows(exams)
    both = [("all", every), ("primary", every.where("primary_exam"))]
    parts = [quality.cohort_contract(df, "patient_id", "case_id").withColumn("cohort", F.lit(n)) for n, df in both]
    return parts[0].unionByName(parts[1])


@query(
    "mirror_consistency",
    """SELECT vec_id AS bag, len(embedding)::BIGINT AS n_document, len(embedding) - CASE WHEN vec_id % 70 = 0 THEN 1 ELSE 0 END AS n_rows, vec_id % 70 <> 0 AS ok FROM embeddings""",
)
def _(spark, folder):
    doc = table(spark, folder, "embeddings").select(F.col("vec_id").alias("bag"), F.size("embedding").cast("bigint").alias("n_document"))
    rows = fx.bags(spark, folder).where("NOT (bag % 70 = 0 AND pos = 5)").groupBy("bag").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.coalesce("n_rows", F.lit(0))
    return doc.join(rows, "bag", "left").select("bag", "n_document", n.alias("n_rows"), (F.col("n_document") == n).alias("ok"))


@query(
    "cohort_agreement",
    """WITH o AS (SELECT c_custkey AS k, c_mktsegment AS g FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN lower(c_mktsegment) ELSE 'OTHER' END AS g FROM customer WHERE c_mktsegment <> 'BUILDING'),
      b AS (SELECT o.k AS a, n.k AS c, o.g AS og, n.g AS ng FROM o FULL JOIN n ON o.k = n.k)
    SELECT count(*) FILTER (a IS NOT NULL AND c IS NOT NULL) AS n_both, count(*) FILTER (c IS NULL) AS n_old_only, count(*) FILTER (a IS NULL) AS n_new_only, count(*) FILTER (a IS NOT NULL AND c IS NOT NULL) AS n_comparable,
      count(*) FILTER (upper(og) = upper(ng)) AS n_agree, round(count(*) FILTER (upper(og) = upper(ng)) / count(*) FILTER (a IS NOT NULL AND c IS NOT NULL)::DOUBLE, 6) AS rate, bool_and(a IS NOT NULL AND c IS NOT NULL) AS same_keys FROM b""",
)
def _(spark, folder):
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")
    old = c.where("c_acctbal > 0").select(key.alias("k"), F.col("c_mktsegment").alias("old_group"))
    new = c.where("c_mktsegment <> 'BUILDING'").select(key.alias("k"), F.when(key % 4 > 0, F.lower("c_mktsegment")).otherwise("OTHER").alias("new_group"))
    return rounded(quality.agreement(joins.outer_bridge(old, new, ["k"]), "old_group", "new_group"), "rate")


@query(
    "orientation_check",
    with_views("f_stone", body="""WITH c AS (SELECT case_id, avg(part) FILTER (side = 'LEFT') AS l, avg(part) FILTER (side = 'RIGHT') AS r FROM f_stone GROUP BY case_id)
      SELECT case_id, round(l, 6) AS left_centroid, round(r, 6) AS right_centroid, l > r AS orientation_ok FROM c"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder)
    of = lambda side: F.avg(F.when(F.col("side") == side, F.col("part")))
    c = s.groupBy("case_id").agg(of("LEFT").alias("l"), of("RIGHT").alias("r"))
    return c.select(
        "case_id", f6(F.col("l")).alias("left_centroid"), f6(F.col("r")).alias("right_centroid"), (F.col("l") > F.col("r")).alias("orientation_ok")
    )


def saturation_check(spark, folder):
    s = agg.saturation(voxels(spark, folder), "hu")
    of = lambda w: F.max(F.when(F.col("window") == w, F.col("stone_voxel_saturation")))
    detail = F.concat(F.lit("stone="), F.round(of("stone"), 4).cast("string"), F.lit(", soft="), F.round(of("soft"), 4).cast("string"))
    return quality.check(s, "saturation", (of("stone") < 0.10) & (of("soft") > 0.50), detail)


def split_check(spark, folder):
    l = folds.leaks(fold_rows(spark, folder))
    detail = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" seeds, "), F.sum("n_leaks").cast("string"), F.lit(" leaks"))
    return quality.check(l, "splits", F.sum("n_leaks") == 0, detail)


def roundtrip_check(spark, folder):
    both = rep.round_trips(report_facts(spark, folder), ["en", "tr"], SEED)
    bad = F.count_if(F.size("differences") > 0)
    detail = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" texts, "), bad.cast("string"), F.lit(" differ"))
    return quality.check(both, "roundtrip", bad == 0, detail)


def lossless_check(spark, folder):
    n, bad = F.sum("n_tested"), F.sum("n_mismatch")
    detail = F.concat(n.cast("string"), F.lit(" cells, "), bad.cast("string"), F.lit(" differ"))
    return quality.check(lossless_cells(spark, folder), "lossless", bad == 0, detail)


LOSSLESS_SQL = """SELECT 'lossless' AS name, sum(b) = 0 AS ok, sum(n) || ' cells, ' || sum(b) || ' differ' AS detail FROM (SELECT count(*) + CASE WHEN vec_id % 40 = 0 THEN 1 ELSE 0 END AS n,
      CASE WHEN vec_id % 50 = 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 40 = 0 THEN 1 ELSE 0 END AS b FROM (SELECT vec_id, unnest(embedding) FROM embeddings) GROUP BY vec_id)"""


def selection_check(spark, folder):
    """Every case has a standard series."""
    rows = series_rows(spark, folder)
    chosen = selection.select_roles(rows).where("role = 'axial_std'").select("case_id", F.lit(True).alias("has"))
    cases = rows.select("case_id").distinct().join(chosen, "case_id", "left")
    bad = F.count_if(F.col("has").isNull())
    return quality.check(cases, "selected", bad == 0, F.concat(F.count(F.lit(1)).cast("string"), F.lit(" cases, "), bad.cast("string"), F.lit(" without a standard series")))


SELECTED_SQL = """SELECT 'selected' AS name, count(*) FILTER (NOT a) = 0 AS ok, count(*) || ' cases, ' || count(*) FILTER (NOT a) || ' without a standard series' AS detail FROM
      (SELECT l_orderkey, bool_or(l_partkey % 4 < 2) AS a FROM lineitem GROUP BY 1)"""


def schema_rows_check(spark, folder):
    ok = F.count_if("valid")
    n = F.count(F.lit(1))
    return quality.check(schema_rows(spark, folder), "schema", ok == n, F.concat(ok.cast("string"), F.lit("/"), n.cast("string")))


SCHEMA_CHECK_SQL = """SELECT 'schema' AS name, bool_and(v) AS ok, count(*) FILTER (v) || '/' || count(*) AS detail FROM
      (SELECT CAST(regexp_extract(props, '\\d+') AS INTEGER) BETWEEN 0 AND 90 AND event_id % 100 <> 0 AS v FROM events)"""


def every_check(spark, folder):
    g = golden(spark, folder)
    counts = quality.check(g, "golden", F.bool_and("ok"), F.concat(F.count_if("ok").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")))
    parts = [
        lossless_check, coverage_check, geometry_check, parse_check, linkage_check, phi_check, selection_check, saturation_check, roundtrip_check,
        schema_rows_check, split_check,
    ]
    return quality.report([counts, *[p(spark, folder) for p in parts]])


QA_SQL = with_views(
    "f_case", "f_axis",
    body=f"""WITH {GAPS_SQL}, v AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) % 4096 - 1000 AS hu FROM lineitem),
      sa AS (SELECT count(*) FILTER (hu >= 200 AND round_even(255 * least(greatest((hu + 350) / 1500.0::DOUBLE, 0), 1), 0) = 255) / count(*) FILTER (hu >= 200)::DOUBLE AS st,
        count(*) FILTER (hu >= 200 AND round_even(255 * least(greatest((hu + 160) / 400.0::DOUBLE, 0), 1), 0) = 255) / count(*) FILTER (hu >= 200)::DOUBLE AS so FROM v)
    {COVERAGE_SQL} UNION ALL {GEOMETRY_SQL} UNION ALL {PARSE_SQL} UNION ALL {LINKAGE_SQL} UNION ALL SELECT 'golden', bool_and(ok), count(*) FILTER (ok) || '/' || count(*) FROM ({GOLDEN_SQL})
    UNION ALL SELECT 'saturation', st < 0.1 AND so > 0.5, 'stone=' || round(st, 4) || ', soft=' || round(so, 4) FROM sa
    UNION ALL {LOSSLESS_SQL} UNION ALL SELECT * FROM ({PHI_CHECK_SQL}) UNION ALL {SELECTED_SQL} UNION ALL {SCHEMA_CHECK_SQL}
    UNION ALL SELECT 'splits', true, '5 seeds, 0 leaks' UNION ALL SELECT 'roundtrip', true, count(*) * 2 || ' texts, 0 differ' FROM f_case""",
)


@query("qa_report", QA_SQL)
def _(spark, folder):
    return every_check(spark, folder)


@query("qa_overall", f"SELECT count(*) AS n_checks, count(*) FILTER (ok) AS n_passed, bool_and(ok) AS passed FROM ({QA_SQL})")
def _(spark, folder):
    return quality.overall(every_check(spark, folder))
