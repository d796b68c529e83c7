"""Fact sets, reports and the round trip between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.functions import reports as R
from cohortine.functions import vocab as V
from cohortine.functions.scalars import mm_text
from cohortine.operators import evaluation as ev
from cohortine.operators import reports as rep
from cohortine.plans.evaluated import REF_SQL, SEED_LIST, ref_stones
from cohortine.plans.grouped import DET, detections
from cohortine.plans.registry import query
from cohortine.plans.rows import f6, kidneys
from cohortine.sources import fixtures as fx
from cohortine.sources.fixtures import with_views

REC = ("f_case", "f_stone", "f_rec")
SEED = V.SEEDS[0]


def facts(spark, folder):
    return rep.build_factset(
        fx.report_records(spark, folder), fx.report_stones(spark, folder), ["side_rank", "zone"]
    )


def flat(df):
    """Fact sets as plain columns."""

    def side(k):
        s = F.transform(
            F.col(f"{k}.stones"), lambda x: F.concat_ws(",", x["zone"], mm_text(x["mm"]), F.coalesce(x["cls"], F.lit("-")))
        )
        return [
            F.col(f"{k}.present").alias(f"{k}_present"), F.col(f"{k}.max_mm").alias(f"{k}_max_mm"), F.col(f"{k}.max_cls").alias(f"{k}_max_cls"),
            F.array_join(f"{k}.zones", ",").alias(f"{k}_zones"), F.array_join(s, ";").alias(f"{k}_stones"),
        ]

    big = F.when(F.col("largest").isNotNull(), F.concat_ws(",", "largest.side", "largest.zone", mm_text(F.col("largest.mm")), "largest.cls"))
    return rep.with_hash(df).select(
        "case_id", "laterality", F.col("total_n").cast("bigint").alias("total_n"), "total_qualifier", F.col("n_characterized").cast("bigint").alias("n"),
        *side("right"), *side("left"), F.coalesce(big, F.lit("")).alias("largest"), F.array_join("anomalies", ",").alias("anomalies"), "facts_hash",
    )


FLAT_SQL = """SELECT case_id, laterality, total_n, total_qualifier, n, right_present, right_max_mm, right_max_cls, right_zones, right_stones,
  left_present, left_max_mm, left_max_cls, left_zones, left_stones, coalesce(big_side || ',' || big_zone || ',' || big_mm || ',' || big_cls, '') AS largest, anomalies, facts_hash FROM r_hash"""


@query("build_factset", with_views(*REC, body=FLAT_SQL))
def _(spark, folder):
    return flat(facts(spark, folder))


@query("facts_hash", with_views(*REC, body="SELECT count(*) AS n, count(DISTINCT facts_hash) AS n_distinct, min(facts_hash) AS first_hash, max(facts_hash) AS last_hash FROM r_hash"))
def _(spark, folder):
    h = rep.with_hash(facts(spark, folder))
    return h.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("facts_hash").alias("n_distinct"),
        F.min("facts_hash").alias("first_hash"), F.max("facts_hash").alias("last_hash"),
    )


@query("stone_tuples", with_views(*REC, body="SELECT case_id, side, zone, cls FROM r_cls"))
def _(spark, folder):
    return rep.stone_tuples(facts(spark, folder))


def _draw(slot: str, n: int) -> str:
    return f"CAST(('0x' || substr(sha256('{SEED}|' || case_id || '|{slot}'), 1, 7))::BIGINT % {n} AS INTEGER)"


VARIANTS_SQL = ", ".join(
    f"{_draw(k, n)} AS {a}"
    for k, n, a in (("opening", 3, "opening"), ("verb", 4, "verb"), ("measure", 3, "measure"), ("impression", 3, "impression"), ("order", 2, "turn"))
)


@query("choose_variants", with_views("f_case", body=f"SELECT case_id, {VARIANTS_SQL} FROM f_case"))
def _(spark, folder):
    v = R.choose_variants(F.col("case_id"), SEED)
    return fx.cases(spark, folder).select("case_id", v.alias("v")).select(
        "case_id", "v.opening", "v.verb", "v.measure", "v.impression", F.col("v.order").alias("turn")
    )


def _words(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in table.items()) + " END"


def _pick(words: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _notes(table: dict[str, str]) -> str:
    """Anomaly sentences in sorted order of their names."""
    mod = {"HORSESHOE_KIDNEY": 11, "MANY_SMALL_STONES_MIMIC_LARGE": 13, "HYPERDENSE_PYRAMID_MIMIC": 17,
           "COMPLICATED_CYST_HYPERDENSE_LESION": 19, "URETERAL_STONE_PRESENT": 23, "BLADDER_DIVERTICULUM_STONE": 29}
    return ", ".join(f"CASE WHEN w.case_id % {mod[k]} = 0 THEN '{table[k]}' END" for k in sorted(mod))


CLS_EN, ZONE_EN = _words(V.SIZE_CLASS_EN, "cls"), _words(V.ZONE_EN, "zone")
CLS_TR, ZONE_TR = _words({k: w.lower() for k, w in V.SIZE_CLASS_TR.items()}, "cls"), _words(V.ZONE_TR, "zone")
BIG_EN = f"{_words(V.ZONE_EN, 'big_zone')} || ', ' || big_mm || ' mm (' || {_words(V.SIZE_CLASS_EN, 'big_cls')} || ')'"
BIG_TR = f"{_words(V.ZONE_TR, 'big_zone')} || 'da ' || big_mm || ' mm (' || {_words({k: w.lower() for k, w in V.SIZE_CLASS_TR.items()}, 'big_cls')} || ')'"

EN_SQL = f"""WITH v AS (SELECT *, {VARIANTS_SQL} FROM r_hash),
    w AS (SELECT *, n > 0 AND total_n = 1 AND n = 1 AS single FROM v),
    c AS (SELECT q.*, v.measure % 2 AS m, {ZONE_EN} || CASE WHEN ns = 1 THEN ' of the ' || lower(side) || ' kidney' ELSE '' END AS loc, coalesce({CLS_EN}, 'of unknown size') AS cl,
      CASE WHEN starts_with(mmt, '8') OR split_part(mmt, '.', 1) IN ('11', '18') THEN 'an' ELSE 'a' END AS art FROM r_cls q JOIN v ON v.case_id = q.case_id),
    t AS (SELECT *, CASE WHEN mm IS NULL THEN 'a calculus of indeterminate size (' || cl || ') in the ' || loc WHEN m = 1 THEN 'a calculus in the ' || loc || ' measuring ' || mmt || ' mm (' || cl || ')'
      ELSE art || ' ' || mmt || ' mm calculus (' || cl || ') in the ' || loc END AS clause FROM c),
    b AS (SELECT case_id, side, any_value(ns) AS ns, string_agg(CASE WHEN rn = 1 THEN '' WHEN rn = ns THEN ' and ' ELSE ', ' END || clause, '' ORDER BY rn) AS body FROM t GROUP BY case_id, side),
    s AS (SELECT b.case_id, side, CASE WHEN ns = 1 THEN body || ' ' || {_pick(V.VERB_EN, 'verb')} || '.' ELSE {_pick([""] + V.NUMBER_EN, 'ns').replace(" END", " ELSE ns::VARCHAR END")} || ' calculi ' ||
      replace({_pick(V.VERB_EN, 'verb')}, 'is ', 'are ') || ' in the ' || lower(side) || ' kidney: ' || body || '.' END AS sent, ns,
      (CASE WHEN side = 'RIGHT' THEN turn = 0 OR ln_ = 0 ELSE turn = 1 OR rn_ = 0 END) AS first, {_pick(V.OPENING_EN, 'opening')} || ', ' AS lead FROM b JOIN w ON w.case_id = b.case_id),
    x AS (SELECT case_id, side, CASE WHEN first THEN lead || lower(sent[1]) || sent[2:] ELSE upper(sent[1]) || sent[2:] END AS sent FROM s),
    f AS (SELECT w.case_id, concat_ws(' ', CASE WHEN turn = 1 THEN l.sent ELSE r.sent END, CASE WHEN turn = 1 THEN r.sent ELSE l.sent END,
      CASE WHEN turn = 1 THEN ul ELSE ur END, CASE WHEN turn = 1 THEN ur ELSE ul END, CASE WHEN NOT right_present AND NOT left_present THEN 'No calculus was identified in either kidney.' END,
      CASE WHEN many THEN 'Numerous calculi, too many to count, are present in the kidneys.' WHEN total_n > n THEN 'A total of ' || total_n || ' calculi were reported, of which ' || n || CASE WHEN n = 1 THEN ' is' ELSE ' are' END || ' individually described.' END,
      {_notes(V.ANOMALY_EN)}) AS findings,
      CASE WHEN laterality = 'NONE' THEN 'No renal calculus identified.' ELSE concat_ws(' ', CASE laterality WHEN 'BILATERAL' THEN 'Bilateral' WHEN 'RIGHT' THEN 'Right-sided' ELSE 'Left-sided' END || ' nephrolithiasis' ||
        CASE WHEN big_side IS NOT NULL THEN CASE WHEN coalesce(single, false) THEN '; the calculus is' ELSE '; the largest calculus is' END || ' in the ' || lower(big_side) || ' ' || {BIG_EN} ELSE '' END || '.',
        CASE WHEN many THEN 'The number of calculi was described as numerous.' WHEN total_n = 1 THEN 'A single renal calculus was identified.' WHEN total_n IS NOT NULL THEN 'A total of ' || total_n || ' renal calculi were identified.' END) END AS impression
      FROM (SELECT *, CASE WHEN right_present AND rn_ = 0 THEN 'A calculus is also present in the right kidney but was not separately characterized.' END AS ur,
        CASE WHEN left_present AND ln_ = 0 THEN 'A calculus is also present in the left kidney but was not separately characterized.' END AS ul FROM w) w
      LEFT JOIN x r ON r.case_id = w.case_id AND r.side = 'RIGHT' LEFT JOIN x l ON l.case_id = w.case_id AND l.side = 'LEFT')
    SELECT case_id, findings, impression FROM f"""

TR_SQL = f"""WITH v AS (SELECT *, {VARIANTS_SQL} FROM r_hash), w AS (SELECT *, coalesce(total_n = 1 AND n = 1, false) AS single FROM v),
    t AS (SELECT q.*, {ZONE_TR} || 'da ' || CASE WHEN mm IS NULL THEN 'boyutu ölçülemeyen' WHEN measure = 0 THEN mmt || ' mm boyutunda' WHEN measure = 1 THEN 'boyutu ' || mmt || ' mm ölçülen' ELSE mmt || ' mm çapında' END ||
      ' (' || coalesce({CLS_TR}, 'boyutu bilinmiyor') || ')' AS clause FROM r_cls q JOIN v ON v.case_id = q.case_id),
    b AS (SELECT case_id, side, any_value(ns) AS ns, string_agg(CASE WHEN rn = 1 THEN '' WHEN rn = ns THEN ' ve ' ELSE ', ' END || clause, '' ORDER BY rn) AS body FROM t GROUP BY case_id, side),
    x AS (SELECT b.case_id, side, CASE WHEN CASE WHEN side = 'RIGHT' THEN turn = 0 OR ln_ = 0 ELSE turn = 1 OR rn_ = 0 END THEN {_pick(V.OPENING_TR, 'opening')} || CASE side WHEN 'RIGHT' THEN ' sağ böbrek ' ELSE ' sol böbrek ' END
      ELSE CASE side WHEN 'RIGHT' THEN 'Sağ böbrek ' ELSE 'Sol böbrek ' END END || body || CASE WHEN ns = 1 THEN ' taş dansitesi ' ELSE ' taş dansiteleri ' END || {_pick(V.VERB_TR, 'verb')} || '.' AS sent FROM b JOIN w ON w.case_id = b.case_id),
    f AS (SELECT w.case_id, concat_ws(' ', CASE WHEN turn = 1 THEN l.sent ELSE r.sent END, CASE WHEN turn = 1 THEN r.sent ELSE l.sent END,
      CASE WHEN turn = 1 THEN ul ELSE ur END, CASE WHEN turn = 1 THEN ur ELSE ul END, CASE WHEN NOT right_present AND NOT left_present THEN 'Her iki böbrekte taş dansitesi izlenmedi.' END,
      CASE WHEN many THEN 'Böbreklerde sayılamayacak kadar çok sayıda taş dansitesi mevcuttur.' WHEN total_n > n THEN 'Toplam ' || total_n || ' adet taş dansitesi izlenmiş olup, bunlardan ' || n || ' tanesi ' || CASE WHEN n = 1 THEN '' ELSE 'ayrı ayrı ' END || 'tanımlanmıştır.' END,
      {_notes(V.ANOMALY_TR)}) AS findings,
      CASE WHEN laterality = 'NONE' THEN 'Böbrek taşı saptanmamıştır.' ELSE concat_ws(' ', CASE laterality WHEN 'BILATERAL' THEN {_pick(V.BILATERAL_TR, 'impression')} WHEN 'RIGHT' THEN 'Sağ böbrekte nefrolitiazis' ELSE 'Sol böbrekte nefrolitiazis' END ||
        CASE WHEN big_side IS NOT NULL THEN CASE WHEN single THEN '; taş ' ELSE '; en büyük taş ' END || CASE big_side WHEN 'RIGHT' THEN 'sağ' ELSE 'sol' END || ' böbrek ' || {BIG_TR} ELSE '' END || '.',
        CASE WHEN many THEN 'Taş sayısı çok sayıda olarak tanımlanmıştır.' WHEN single THEN 'Tek adet böbrek taşı saptanmıştır.' WHEN total_n IS NOT NULL THEN 'Toplam ' || total_n || ' adet böbrek taşı saptanmıştır.' END) END AS impression
      FROM (SELECT *, CASE WHEN right_present AND rn_ = 0 THEN 'Sağ böbrekte de taş dansitesi mevcut olup ayrıca tanımlanmamıştır.' END AS ur,
        CASE WHEN left_present AND ln_ = 0 THEN 'Sol böbrekte de taş dansitesi mevcut olup ayrıca tanımlanmamıştır.' END AS ul FROM w) w
      LEFT JOIN x r ON r.case_id = w.case_id AND r.side = 'RIGHT' LEFT JOIN x l ON l.case_id = w.case_id AND l.side = 'LEFT')
    SELECT case_id, findings, impression FROM f"""


@query("render_report", with_views(*REC, body=EN_SQL))
def _(spark, folder):
    return rep.render_reports(facts(spark, folder), "en", SEED).select("case_id", "findings", "impression")


@query("render_report_tr", with_views(*REC, body=TR_SQL))
def _(spark, folder):
    return rep.render_reports(facts(spark, folder), "tr", SEED).select("case_id", "findings", "impression")


@query("parse_report", with_views(*REC, body=FLAT_SQL))
def _(spark, folder):
    return flat(rep.parse_reports(rep.render_reports(facts(spark, folder), "en", SEED), "en"))


@query("parse_report_tr", with_views(*REC, body=FLAT_SQL))
def _(spark, folder):
    return flat(rep.parse_reports(rep.render_reports(facts(spark, folder), "tr", SEED), "tr"))


@query(
    "diff_facts",
    with_views(*REC, body="""SELECT case_id, concat_ws('|', CASE WHEN case_id % 3 = 0 THEN 'total_n' END, CASE WHEN case_id % 4 = 0 AND laterality <> 'NONE' THEN 'laterality' END) AS differences FROM r_hash"""),
)
def _(spark, folder):
    a = facts(spark, folder)
    k = F.col("case_id")
    b = a.withColumn("total_n", F.when(k % 3 == 0, F.lit(-1)).otherwise(F.col("total_n"))).withColumn(
        "laterality", F.when(k % 4 == 0, "NONE").otherwise(F.col("laterality"))
    )
    d = rep.diff_facts(a, b)
    return d.select("case_id", F.array_join(F.reverse(F.sort_array("differences")), "|").alias("differences"))


@query(
    "roundtrip_gate",
    with_views(*REC, body="""SELECT l.lang, count(*) AS n, count(*) AS n_ok, '' AS first_failure, true AS passed FROM r_hash CROSS JOIN (VALUES ('en'), ('tr')) l(lang) GROUP BY l.lang"""),
)
def _(spark, folder):
    ok = F.size("differences") == 0
    return rep.round_trips(facts(spark, folder), ["en", "tr"], SEED).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"),
        F.coalesce(F.min(F.when(~ok, F.concat_ws(":", F.col("case_id").cast("string"), F.array_join("differences", ",")))), F.lit("")).alias("first_failure"),
        F.bool_and(ok).alias("passed"),
    )


@query(
    "predicted_facts",
    with_views(*DET, body=f"""WITH {REF_SQL} SELECT seed, case_id, CASE WHEN bool_or(present AND side = 'RIGHT') AND bool_or(present AND side = 'LEFT') THEN 'BILATERAL' WHEN bool_or(present AND side = 'RIGHT') THEN 'RIGHT' WHEN bool_or(present AND side = 'LEFT') THEN 'LEFT' ELSE 'NONE' END AS laterality,
      count(zone) AS n, coalesce(max(CASE WHEN side = 'RIGHT' THEN zone || ',' || CASE cls WHEN 'SMALL' THEN 'KUCUK' WHEN 'MEDIUM' THEN 'ORTA' ELSE 'BUYUK' END END), '') AS right_stone,
      coalesce(max(CASE WHEN side = 'LEFT' THEN zone || ',' || CASE cls WHEN 'SMALL' THEN 'KUCUK' WHEN 'MEDIUM' THEN 'ORTA' ELSE 'BUYUK' END END), '') AS left_stone FROM g GROUP BY seed, case_id"""),
)
def _(spark, folder):
    p = rep.predicted_facts(ev.predicted_sides(detections(spark, folder)))
    stone = lambda k: F.coalesce(
        F.concat(F.get(f"{k}.stones", F.lit(0))["zone"], F.lit(","), F.get(f"{k}.stones", F.lit(0))["cls"]), F.lit("")
    )
    return p.select(
        "seed", "case_id", "laterality", F.col("n_characterized").cast("bigint").alias("n"), stone("right").alias("right_stone"), stone("left").alias("left_stone")
    )


@query(
    "predicted_roundtrip",
    with_views(*DET, body="SELECT seed, l.lang, count(DISTINCT case_id) AS n, 1.0::DOUBLE AS success FROM f_det CROSS JOIN (VALUES ('en'), ('tr')) l(lang) GROUP BY ALL"),
)
def _(spark, folder):
    """Every report is counted; those that are equal word by word are written and read once."""
    pairs = rep.side_pairs(ev.predicted_sides(detections(spark, folder)))
    key = F.concat_ws("#", F.col("case_id").cast("string"), F.col("seed").cast("string"))
    f = rep.pair_facts(rep.equal_reports(pairs.withColumn("case_id", key), SEED), ["n"])
    both = [rep.round_trip(f, lang, SEED, ["laterality"], ["stones"], ["seed", "n"]).withColumn("lang", F.lit(lang)) for lang in ("en", "tr")]
    good = F.sum(F.when(F.size("differences") == 0, F.col("n")).otherwise(0))
    return both[0].unionByName(both[1]).groupBy("seed", "lang").agg(F.sum("n").alias("n"), (good / F.sum("n")).alias("success"))


@query(
    "reference_facts",
    with_views(*DET, body="""SELECT k.case_id, k.side, has_stone AS present, count(s.zone5) AS n_characterized, coalesce(string_agg(DISTINCT s.zone5, ',' ORDER BY s.zone5), '') AS zones, max(s.seen_mm) AS max_mm,
      any_value(CASE WHEN max_class IN ('MIKROLITIYAZIS', 'KUCUK') THEN 'SMALL' WHEN max_class = 'ORTA' THEN 'MEDIUM' WHEN max_class IS NOT NULL THEN 'LARGE' END) AS max_cls
      FROM f_kidney k LEFT JOIN f_stone s ON s.case_id = k.case_id AND s.side = k.side GROUP BY k.case_id, k.side, has_stone"""),
)
def _(spark, folder):
    s = fx.stones(spark, folder).select("case_id", "side", F.col("zone5").alias("zone"), F.col("seen_mm").alias("mm"))
    return rep.reduced_facts(kidneys(spark, folder), s)


@query(
    "case_comparison",
    with_views(*DET, body="""WITH m AS (SELECT case_id, side, avg(p) AS p, avg(z_hat) AS z FROM f_det GROUP BY ALL)
      SELECT k.case_id, k.side, has_stone, n_characterized, max_mm, max_class, round(p, 6) AS p_stone, round(z, 6) AS z_hat, (p > 0.5) <> has_stone AS disagreement,
        CASE WHEN (p > 0.5) <> has_stone THEN CASE WHEN has_stone AND n_characterized = 0 THEN 'label without a characterized stone' ELSE 'disagreement despite the label, worth review' END END AS reason
      FROM f_kidney k JOIN m ON m.case_id = k.case_id AND m.side = k.side"""),
)
def _(spark, folder):
    c = rep.case_comparison(kidneys(spark, folder), detections(spark, folder))
    return c.withColumn("p_stone", f6(F.col("p_stone"))).withColumn("z_hat", f6(F.col("z_hat")))
