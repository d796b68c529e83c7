"""Joins and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.operators import joins, linkage, terms
from cohortine.plans.registry import query
from cohortine.plans.rows import ORDER, f6
from cohortine.sources import fixtures as fx
from cohortine.sources.fixtures import with_views
from cohortine.sources.tables import table


@query(
    "attach_group",
    with_views("f_case", body="""SELECT case_id, patient_id, c_mktsegment AS grp FROM f_case
      LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = patient_id"""),
)
def _(spark, folder):
    groups = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("grp")
    )
    return fx.cases(spark, folder).join(groups, "patient_id", "left").select("case_id", "patient_id", "grp")


def _cohorts(spark, folder):
    old = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("old_group")
    )
    new = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy(
        F.col("o_custkey").alias("patient_id")
    ).agg(F.min("o_orderpriority").alias("new_group"))
    return old, new


COHORTS_SQL = """o AS (SELECT c_custkey AS patient_id, c_mktsegment AS old_group FROM customer WHERE c_acctbal > 0),
    n AS (SELECT o_custkey AS patient_id, min(o_orderpriority) AS new_group FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


@query(
    "cohort_bridge",
    f"""WITH {COHORTS_SQL} SELECT coalesce(o.patient_id, n.patient_id) AS patient_id, old_group, new_group,
      CASE WHEN o.patient_id IS NULL THEN 'right_only' WHEN n.patient_id IS NULL THEN 'left_only' ELSE 'both' END AS origin
    FROM o FULL JOIN n ON o.patient_id = n.patient_id""",
)
def _(spark, folder):
    return joins.outer_bridge(*_cohorts(spark, folder), ["patient_id"])


def presence(spark, folder):
    c = table(spark, folder, "customer").where("c_acctbal > 0")
    o = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    d = table(spark, folder, "labels")
    return joins.presence_audit(
        {
            "in_primary": c.select(F.col("c_custkey").alias("key")),
            "in_secondary": o.select(F.col("o_custkey").alias("key")),
            "has_folder": d.select(F.col("doc_id").alias("key")),
        },
        "key",
    )


PRESENCE_SQL = """k AS (SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders UNION SELECT doc_id FROM labels),
    p AS (SELECT key, key IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS in_primary,
      key IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS in_secondary,
      key IN (SELECT doc_id FROM labels) AS has_folder FROM k)"""


@query("presence_audit", f"WITH {PRESENCE_SQL} SELECT * FROM p WHERE in_primary OR in_secondary OR has_folder")
def _(spark, folder):
    return presence(spark, folder)


@query(
    "presence_overlaps",
    f"""WITH {PRESENCE_SQL} SELECT count(*) FILTER (in_primary AND in_secondary AND has_folder) AS all_three,
      count(*) FILTER (in_primary AND in_secondary) AS primary_secondary, count(*) FILTER (in_secondary AND has_folder) AS secondary_folder,
      count(*) FILTER (in_primary AND NOT in_secondary) AS primary_only, count(*) FILTER (in_secondary AND NOT has_folder) AS no_folder FROM p""",
)
def _(spark, folder):
    a, b, c = F.col("in_primary"), F.col("in_secondary"), F.col("has_folder")
    return presence(spark, folder).agg(
        F.count_if(a & b & c).alias("all_three"), F.count_if(a & b).alias("primary_secondary"),
        F.count_if(b & c).alias("secondary_folder"), F.count_if(a & ~b).alias("primary_only"),
        F.count_if(b & ~c).alias("no_folder"),
    )


@query(
    "labelled_holdout",
    """SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labeled' ELSE 'holdout_unlabeled' END AS "group" FROM documents""",
)
def _(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    return joins.split_by_membership(d, table(spark, folder, "labels"), "doc_id", ("labeled", "holdout_unlabeled"))


def letters(key):
    """Digits of a key as letters, so that keys survive name folding."""
    return F.translate(F.lpad(key.cast("string"), 8, "0"), "0123456789", "abcdefghjk")


def linkage_tables(spark, folder):
    """Label names, folder names and hand-verified aliases from the customer table."""
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "k")
    name = F.concat(F.lit("Ad "), letters(F.col("k")))
    label = c.where(F.col("k") % 7 != 6).select(name.alias("label_name"), F.col("k").alias("row_index"))
    folder_name = F.concat(
        fx.word_by(F.col("k") % 7, ["Ad ", "AD", "ad ", "Zz ", "Ad ", "âd", "Qq "]),
        F.when(F.col("k") % 7 == 1, F.upper(letters(F.col("k")))).otherwise(letters(F.col("k"))),
        F.when(F.col("k") % 7 == 2, " + üreter taşı").otherwise(""),
    )
    folders = c.where(F.col("k") % 7 != 4).select(
        F.explode(F.array(folder_name, F.when(F.col("k") % 14 == 1, F.concat(folder_name, F.lit("-2"))))).alias("folder")
    ).where(F.col("folder").isNotNull())
    aliases = c.where(F.col("k") % 7 == 3).select(
        name.alias("alias_name"), F.concat(F.lit("Zz "), letters(F.col("k"))).alias("folder_name")
    )
    return label, folders, aliases


LETTERS_SQL = "translate(lpad(k::VARCHAR, 8, '0'), '0123456789', 'abcdefghjk')"


@query(
    "record_linkage",
    f"""WITH c AS (SELECT *, {LETTERS_SQL} AS t, k % 7 AS m FROM (SELECT c_custkey AS k FROM customer))
    SELECT CASE m WHEN 3 THEN 'ZZ' WHEN 6 THEN 'QQ' ELSE 'AD' END || upper(t) AS name_key,
      CASE WHEN m <> 6 THEN 'Ad ' || t END AS label_name,
      CASE m WHEN 0 THEN 'Ad ' || t WHEN 1 THEN 'AD' || upper(t) WHEN 2 THEN 'ad ' || t || ' + üreter taşı' WHEN 3 THEN 'Zz ' || t
        WHEN 5 THEN 'âd' || t WHEN 6 THEN 'Qq ' || t END AS first_folder,
      CASE WHEN m <> 6 THEN 1 ELSE 0 END::BIGINT AS n_label_rows,
      CASE WHEN m = 4 THEN 0 WHEN k % 14 = 1 THEN 2 ELSE 1 END::BIGINT AS n_folders,
      CASE WHEN m = 6 THEN 'holdout_unlabeled' ELSE 'labeled' END AS "group",
      CASE m WHEN 0 THEN 'EXACT' WHEN 1 THEN 'ASCII_FOLDED' WHEN 2 THEN 'SUFFIX_STRIPPED' WHEN 3 THEN 'ALIAS' WHEN 5 THEN 'ASCII_FOLDED' ELSE 'NO_IMAGING' END AS method
    FROM c""",
)
def _(spark, folder):
    return linkage.link_records(*linkage_tables(spark, folder))


@query(
    "alias_audit",
    f"""SELECT 'Ad ' || {LETTERS_SQL} AS alias_name, 'ZZ' || upper({LETTERS_SQL}) AS name_key, true AS fired, true AS in_labels
    FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 = 3)""",
)
def _(spark, folder):
    return linkage.alias_audit(*linkage_tables(spark, folder))


@query(
    "duplicate_resolution",
    """WITH r AS (SELECT n_chars % 400 AS key, text FROM documents),
      g AS (SELECT key, count(*) AS n_rows, count(DISTINCT md5(text)) = 1 AS identical FROM r GROUP BY key HAVING count(*) > 1),
      p AS (SELECT doc_id % 400 AS key, count(*) AS n FROM labels GROUP BY 1)
    SELECT g.key, n_rows, coalesce(n, 0)::BIGINT AS n_partners, identical, CASE WHEN identical THEN 'DEDUP_IDENTICAL_ROWS'
      WHEN coalesce(n, 0) >= n_rows THEN 'PAIR_BY_ROW_ORDER' ELSE 'LABEL_AMBIGUOUS' END AS resolution FROM g LEFT JOIN p ON p.key = g.key""",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select(
        (F.col("n_chars") % 400).alias("key"), F.md5(F.col("text").cast("binary")).alias("content")
    )
    partners = table(spark, folder, "labels").groupBy((F.col("doc_id") % 400).alias("key")).agg(
        F.count(F.lit(1)).alias("n_partners")
    )
    return linkage.resolve_duplicates(rows, partners, "key", "content")


@query(
    "pair_by_order",
    with_views("f_stone", body="""WITH x AS (SELECT case_id, side, line, part, row_number() OVER (PARTITION BY case_id, side ORDER BY line, part, supp, price, ship) AS k FROM f_stone)
      SELECT r.case_id, r.k, r.line AS right_line, r.part AS right_part, l.line AS left_line, l.part AS left_part
      FROM (SELECT * FROM x WHERE side = 'RIGHT') r JOIN (SELECT * FROM x WHERE side = 'LEFT') l ON r.case_id = l.case_id AND r.k = l.k"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder).select("case_id", "side", *ORDER)
    lead = F.col("line") * 1.0e9 + F.col("part")
    pairs = joins.pair_by_order(
        s.where("side = 'RIGHT'"), s.where("side = 'LEFT'"), ["case_id"], ORDER, lead, ["line", "part"]
    )
    return pairs.select(
        "case_id", "k", F.col("left.line").alias("right_line"), F.col("left.part").alias("right_part"),
        F.col("right.line").alias("left_line"), F.col("right.part").alias("left_part"),
    )


def candidates(spark, folder):
    """Even rows are candidates, odd rows are findings, a third table holds selected rows."""
    s = fx.stones(spark, folder)
    c = s.where(F.col("line") % 2 == 0).select(
        "case_id", "side", F.concat_ws("-", "line", "part", "supp", "price").alias("candidate_id"),
        F.col("price").alias("volume"), (F.col("part") % 512).alias("y_row"), (F.col("size_mm") / 2).alias("diameter"),
    )
    f = s.where(F.col("line") % 2 == 1).select(
        "case_id", "side", F.concat_ws("-", *ORDER[:4]).alias("stone_index"), F.col("seen_mm").alias("size_mm"), *ORDER
    )
    rows = s.where(F.col("line") == 1).select("case_id", (F.col("supp") * 5).alias("row"))
    return c, f, rows


RANK_SQL = """c AS (SELECT case_id, side, concat_ws('-', line, part, supp, price) AS candidate_id, price, part % 512 AS y_row, size_mm / 2 AS diameter,
      row_number() OVER (PARTITION BY case_id, side ORDER BY price DESC, concat_ws('-', line, part, supp, price)) AS k FROM f_stone WHERE line % 2 = 0),
    s AS (SELECT case_id, side, concat_ws('-', line, part, supp, price) AS stone_index, seen_mm,
      row_number() OVER (PARTITION BY case_id, side ORDER BY seen_mm DESC NULLS LAST, line, part, supp, price, ship) AS k FROM f_stone WHERE line % 2 = 1),
    j AS (SELECT c.case_id, c.side, candidate_id, stone_index, c.k,
      EXISTS (SELECT 1 FROM f_stone r WHERE r.case_id = c.case_id AND r.line = 1 AND abs(r.supp * 5 - c.y_row) <= 10) AS near,
      coalesce(diameter >= 0.4 * seen_mm, false) AS consistent FROM c LEFT JOIN s ON c.case_id = s.case_id AND c.side = s.side AND c.k = s.k)"""


@query(
    "rank_match",
    with_views("f_stone", body=f"""WITH {RANK_SQL} SELECT case_id, side, candidate_id, stone_index,
      CASE WHEN stone_index IS NOT NULL THEN round(0.6::DOUBLE + CASE WHEN near THEN 0.2 ELSE 0 END + CASE WHEN consistent THEN 0.2 ELSE 0 END, 2) END AS match_confidence,
      CASE WHEN stone_index IS NOT NULL THEN 'side|size_rank_' || k || CASE WHEN near THEN '|row_within_10px' ELSE '' END || CASE WHEN consistent THEN '|size_consistent' ELSE '' END
        ELSE '' END AS evidence FROM j"""),
)
def _(spark, folder):
    m = joins.rank_match(*candidates(spark, folder), ORDER)
    return m.withColumn("evidence", F.array_join("match_evidence", "|")).drop("match_evidence")


@query(
    "within_distance",
    with_views("f_stone", body="""SELECT case_id, line, part, EXISTS (SELECT 1 FROM f_stone r WHERE r.case_id = f.case_id AND r.line = 1
      AND abs(r.price - f.price) <= 2500) AS near FROM f_stone f WHERE line > 1"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder)
    points = s.where(F.col("line") > 1).select("case_id", "line", "part", "price")
    targets = s.where(F.col("line") == 1).select("case_id", F.col("price").alias("row"))
    return joins.near_any(points, targets, ["case_id"], "price", "row", 2500).drop("price")


@query(
    "nearest_join",
    with_views("f_axis", body="""WITH p AS (SELECT series, event_id, position AS x FROM f_axis WHERE kind = 'click'),
      t AS (SELECT series, position AS y FROM f_axis WHERE kind = 'purchase')
      SELECT p.series, p.event_id, arg_min(y, (abs(y - x), y)) AS nearest FROM p LEFT JOIN t ON p.series = t.series GROUP BY ALL"""),
)
def _(spark, folder):
    a = fx.axis(spark, folder)
    points = a.where("kind = 'click'").select("series", "event_id", "position")
    targets = a.where("kind = 'purchase'").select("series", "position")
    near = joins.nearest_join(points, targets, ["series"], "position", "position")
    return near.select("series", "event_id", "nearest")


@query(
    "interp_lookup",
    with_views("f_bag", body="""WITH q AS (SELECT vec_id AS bag, least((vec_id % 700) / 10.0::DOUBLE, 63) AS x FROM embeddings)
      SELECT q.bag, round(a.logit + (b.logit - a.logit) * (x - floor(x)), 6) AS value FROM q
      JOIN f_bag a ON a.bag = q.bag AND a.pos = floor(x) JOIN f_bag b ON b.bag = q.bag AND b.pos = ceil(x)"""),
)
def _(spark, folder):
    q = table(spark, folder, "embeddings").select(F.col("vec_id").alias("bag"), ((F.col("vec_id") % 700) / 10.0).alias("x"))
    out = joins.interpolate(q, fx.bags(spark, folder), ["bag"], "x", "pos", "logit")
    return out.select("bag", f6(F.col("interpolated")).alias("value"))


@query(
    "band_of_point",
    with_views("f_stone", body="""WITH e AS (SELECT case_id, min(price) AS lo, max(price) AS hi FROM f_stone GROUP BY case_id)
      SELECT case_id, line, part, CASE WHEN hi = lo THEN NULL WHEN (price - lo) / (hi - lo) >= 2 / 3.0::DOUBLE THEN 'UPPER'
        WHEN (price - lo) / (hi - lo) >= 1 / 3.0::DOUBLE THEN 'MID' ELSE 'LOWER' END AS band FROM f_stone JOIN e USING (case_id)"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder)
    e = s.groupBy("case_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    band = joins.thirds_band(F.col("price"), F.col("lo"), F.col("hi"))
    return s.join(e, "case_id").select("case_id", "line", "part", band.alias("band"))


PLACES = "unnest(list_filter(range(1, length({u}) - length({t}) + 2), lambda i: substr({u}, i, length({t})) = {t})) - 1"


def benchmark_terms(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.when(F.length("text") >= 200, "passage").otherwise("name").alias("kind"),
        F.col("text").alias("term"), F.col("item_id").alias("term_id"),
    )


@query(
    "term_scan",
    """SELECT doc_id, kind, min(item_id) AS term_id FROM documents d JOIN (SELECT item_id, text AS term,
      CASE WHEN length(text) >= 200 THEN 'passage' ELSE 'name' END AS kind FROM benchmark) b ON contains(upper(d.text), upper(term)) GROUP BY ALL""",
)
def _(spark, folder):
    return terms.scan_terms(table(spark, folder, "documents"), "doc_id", "text", benchmark_terms(spark, folder))


@query(
    "term_hits",
    f"""SELECT doc_id, kind, term_id, md5(term) AS term_md5, {PLACES.format(u="u", t="term")} AS place FROM (SELECT doc_id, upper(text) AS u FROM documents) JOIN (SELECT upper(text) AS term, min(item_id) AS term_id,
      CASE WHEN length(text) >= 200 THEN 'passage' ELSE 'name' END AS kind FROM benchmark GROUP BY 1, 3) ON contains(u, term)""",
)
def _(spark, folder):
    hits = terms.scan_hits(table(spark, folder, "documents"), "doc_id", "text", benchmark_terms(spark, folder))
    return hits.select("doc_id", "kind", "term_id", F.md5(F.col("term").cast("binary")).alias("term_md5"), "place")


def merge_tables(spark, folder):
    """Cases, primary rollup, secondary texts and adjudications."""
    cases = fx.cases(spark, folder).select("case_id")
    s = fx.stones(spark, folder)
    rolled = s.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_listed"), F.bool_or(F.col("side") == "RIGHT").alias("has_right"),
        F.bool_or(F.col("side") == "LEFT").alias("has_left"),
    )
    o = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 6).alias("declared"),
        fx.word_by(F.col("o_orderkey") % 3, ["EXACT", "MANY", "UNKNOWN"]).alias("qualifier"),
    )
    primary = o.join(rolled, "case_id", "left")
    secondary = table(spark, folder, "documents").select(
        F.col("doc_id").alias("case_id"),
        fx.word_by(F.col("n_chars") % 4, ["BILATERAL", "RIGHT", "LEFT", None]).alias("cue"),
        fx.word_by(F.col("n_chars") % 3, ["RIGHT", "LEFT", "UNKNOWN"]).alias("largest_side"),
        (F.col("n_chars") % 20).cast("double").alias("largest_mm"),
        F.when(F.col("n_chars") % 5 == 0, F.col("n_chars") % 9).alias("declared_text"),
    )
    rules = table(spark, folder, "labels").where("quality = 0").select(
        F.col("doc_id").alias("case_id"), (F.col("toxic") == 1).alias("flip"),
        F.when(F.col("doc_id") % 2 == 0, "BILATERAL").alias("force_laterality"),
    )
    return cases, primary, secondary, rules


MERGE_SQL = """r AS (SELECT case_id, count(*) AS n, bool_or(side = 'RIGHT') AS hr, bool_or(side = 'LEFT') AS hl FROM f_stone GROUP BY case_id),
    j AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus <> 'P' THEN coalesce(n, 0) ELSE 0 END AS n0,
      o_orderstatus <> 'P' AND coalesce(hr, false) AS hr, o_orderstatus <> 'P' AND coalesce(hl, false) AS hl,
      CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 = 0 THEN o_custkey % 6 END AS declared,
      CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'MANY' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS qualifier,
      CASE n_chars % 4 WHEN 0 THEN 'BILATERAL' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'LEFT' END AS cue,
      CASE n_chars % 3 WHEN 0 THEN 'RIGHT' WHEN 1 THEN 'LEFT' END AS ls, n_chars % 20 AS lmm,
      CASE WHEN n_chars % 5 = 0 THEN n_chars % 9 END AS dtext,
      quality IS NOT NULL AS adjudicated, coalesce(toxic = 1, false) AS flip, CASE WHEN quality IS NOT NULL AND l.doc_id % 2 = 0 THEN 'BILATERAL' END AS forced
      FROM orders LEFT JOIN r ON r.case_id = o_orderkey LEFT JOIN documents d ON d.doc_id = o_orderkey
      LEFT JOIN (SELECT * FROM labels WHERE quality = 0) l ON l.doc_id = o_orderkey),
    b AS (SELECT *, n0 = 0 AND coalesce(lmm, 0) > 0 AS fallback_used FROM j),
    s AS (SELECT *, n0 + fallback_used::INT AS listed, hr OR (fallback_used AND coalesce(ls, '') = 'RIGHT') AS r, hl OR (fallback_used AND coalesce(ls, '') = 'LEFT') AS l,
      coalesce(declared, dtext) AS dc, CASE WHEN declared IS NULL AND dtext IS NOT NULL THEN 'EXACT' ELSE qualifier END AS q FROM b),
    t AS (SELECT *, (r OR l) AND coalesce((cue = 'RIGHT' AND NOT r) OR (cue = 'LEFT' AND NOT l), false) AS conflict,
      (CASE WHEN flip THEN l ELSE r END) OR coalesce(cue = 'RIGHT', false) AS r2, (CASE WHEN flip THEN r ELSE l END) OR coalesce(cue = 'LEFT', false) AS l2,
      CASE WHEN q <> 'MANY' THEN greatest(coalesce(dc, listed), listed) END AS ne FROM s)"""


@query(
    "merge_sources",
    with_views("f_stone", body=f"""WITH {MERGE_SQL} SELECT case_id, listed::BIGINT AS listed, fallback_used,
      coalesce(forced, CASE WHEN coalesce(cue, '') = 'BILATERAL' OR (r2 AND l2) THEN 'BILATERAL' WHEN r2 THEN 'RIGHT' WHEN l2 THEN 'LEFT' ELSE 'NONE' END) AS laterality,
      conflict, conflict AND adjudicated AS resolved, adjudicated, dc AS declared_count, q AS count_qualifier,
      coalesce(q = 'EXACT' AND dc <> listed, false) AS count_mismatch, ne::BIGINT AS n_effective,
      CASE WHEN ne IS NULL THEN 'MANY_UNSPECIFIED' WHEN ne <= 0 THEN '0' WHEN ne = 1 THEN '1' WHEN ne = 2 THEN '2' WHEN ne <= 4 THEN '3-4' WHEN ne <= 9 THEN '5-9' ELSE '10+' END AS count_bucket FROM t"""),
)
def _(spark, folder):
    return linkage.merge_sources(*merge_tables(spark, folder))


@query(
    "adjudicate",
    with_views("f_stone", body=f"""WITH {MERGE_SQL} SELECT conflict, adjudicated, conflict AND adjudicated AS resolved, count(*) AS n FROM t GROUP BY ALL"""),
)
def _(spark, folder):
    m = linkage.merge_sources(*merge_tables(spark, folder))
    return m.groupBy("conflict", "adjudicated", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "index_remap",
    """WITH m AS (SELECT l_orderkey AS case_id, l_linenumber AS line, l_partkey AS part, l_partkey % 512 AS j, -200.0::DOUBLE + l_suppkey % 7 AS o1, 0.5::DOUBLE + l_tax AS s1,
        -200.0::DOUBLE + l_suppkey % 5 AS o2, 0.5::DOUBLE + l_discount AS s2 FROM lineitem),
      y AS (SELECT *, o1 + j * s1 AS y_mm, (o1 + j * s1 - o2) / s2 AS j_new FROM m)
    SELECT case_id, line, part, round(y_mm, 3) AS y_mm, round(j_new, 4) AS j_new, j_new >= 0 AND j_new < 512 AS inside,
      abs(s1 - s2) < 1e-6 AND abs(o1 - o2) < 1e-6 AS same_frame,
      CASE WHEN bool_and(j_new >= 0 AND j_new < 512) OVER (PARTITION BY case_id) THEN 'high' ELSE 'low' END AS confidence FROM y""",
)
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    items = li.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        (F.col("l_partkey") % 512).alias("j"), (F.col("l_suppkey") % 7 - 200.0).alias("o1"), (F.col("l_tax") + 0.5).alias("s1"),
        (F.col("l_suppkey") % 5 - 200.0).alias("o2"), (F.col("l_discount") + 0.5).alias("s2"),
    )
    moved = joins.remap_index(items, "j", ("o1", "s1"), ("o2", "s2"), 512)
    case = moved.groupBy("case_id").agg(F.bool_and("inside").alias("all_in"))
    return moved.join(case, "case_id").select(
        "case_id", "line", "part", F.round("y_mm", 3).alias("y_mm"), F.round("j_new", 4).alias("j_new"), "inside", "same_frame",
        F.when(F.col("all_in"), "high").otherwise("low").alias("confidence"),
    )
