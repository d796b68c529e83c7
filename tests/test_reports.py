"""Facts -> text -> facts for combinations of sides, zones, sizes, counts and notes, in every wording slot."""

import hashlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from cohortine.functions.scalars import size_class
from cohortine.operators import reports as rep

RECORD = "case_id string, laterality string, n_effective int, qualifier string, anomalies array<string>"
FINDING = "case_id string, side string, zone string, mm double, pos int"
ZONES = ["UPPER", "MID_UPPER", "MID", "MID_LOWER", "LOWER"]
SIZES = [None, 2.5, 8.0, 18.0, 23.0]
COUNTS = [("EXACT", 0), ("EXACT", 4), ("MANY", 0)]
NOTES = [[], ["HORSESHOE_KIDNEY"], ["URETERAL_STONE_PRESENT", "BLADDER_DIVERTICULUM_STONE"]]


def combinations():
    """One case for each side, zone and size; counts and notes take turns. A BILATERAL case has a smaller finding opposite."""
    for i, (side, zone, mm) in enumerate(product(["LEFT", "RIGHT", "BILATERAL"], ZONES, SIZES)):
        (qualifier, more), notes = COUNTS[i % len(COUNTS)], NOTES[(i // len(COUNTS)) % len(NOTES)]
        findings = [("RIGHT" if side == "RIGHT" else "LEFT", zone, mm)]
        if side == "BILATERAL":
            findings.append(("RIGHT", ZONES[(i + 2) % len(ZONES)], 1.5))
        yield f"{side} {zone} {mm}", side, len(findings) + more, qualifier, notes, findings


CASES = list(combinations())


def facts_of(spark, cases):
    records = spark.createDataFrame([c[:5] for c in cases], RECORD)
    findings = [(c[0], *f, at) for c in cases for at, f in enumerate(c[5])]
    table = spark.createDataFrame(findings, FINDING).withColumn("cls", size_class(F.col("mm")))
    return rep.build_factset(records, table, ["pos"]).coalesce(1)


@pytest.fixture(scope="module")
def facts(spark):
    return facts_of(spark, CASES).cache()


@pytest.mark.parametrize("lang", ["en", "tr"])
def test_every_combination_comes_back_in_many_wordings(facts, lang):
    copy = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")
    many = facts.select(copy, "*").withColumn("case_id", F.concat_ws("#", "case_id", "i")).drop("i").coalesce(1)
    rows = rep.round_trip(many, lang, 1337).collect()
    assert len(rows) == 6 * len(CASES)
    assert [r for r in rows if r.differences] == []


def test_equal_size_on_both_sides_is_the_one_ambiguity(spark):
    tie = [("t", "BILATERAL", 2, "EXACT", [], [("LEFT", "MID", 7.0), ("RIGHT", "MID", 7.0)])]
    assert rep.round_trip(facts_of(spark, tie), "en", 1).first().differences == ["largest"]


def test_hash_follows_content(facts):
    h = {r.case_id: r.facts_hash for r in rep.with_hash(facts).collect()}
    again = {r.case_id: r.facts_hash for r in rep.with_hash(facts.repartition(3)).collect()}
    assert h == again and len(set(h.values())) == len(h)


def test_english_article_and_sections(facts):
    text = {r.case_id: r.report for r in rep.render_reports(facts.withColumn("x", F.lit(1)), "en", 7).collect()}
    assert len(text) == len(CASES)
    assert not any(" a 8 mm" in t or " a 18 mm" in t or " an 23 mm" in t for t in text.values())
    assert all("FINDINGS:\n" in t and "\n\nIMPRESSION:\n" in t for t in text.values())


def test_reading_reports_moves_no_rows(spark):
    texts = spark.createDataFrame([(1, "FINDINGS:\nA 5 mm calculus (small) in the mid zone of the left kidney is seen. A total of 3 calculi were reported.")], "case_id int, report string")
    back = rep.parse_reports(texts, "en")
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    r = back.first()
    assert (r.laterality, r.total_n, r.left.stones[0].mm, r.left.zones) == ("LEFT", 3, 5.0, ["MID"])


def test_equal_predicted_reports_are_one_row(spark):
    guess = F.struct(F.lit("MID").alias("zone"), F.lit("SMALL").alias("cls"))
    sides = spark.range(5000).select(F.lit(1).alias("seed"), F.col("id").alias("case_id"), F.lit("LEFT").alias("side"), (F.col("id") % 2 == 0).alias("present"), F.when(F.col("id") % 4 == 0, guess).alias("guess"))
    g = rep.equal_reports(rep.side_pairs(sides), 7).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert g.n == 5000 and g.rows <= 3 * 216


ODD = [
    "", " ", "\n", " \n ", "one", "one\n", "\none. two", "\tone. two\n", "one. \u00a0", "one.\u00a0two. three", "a.\x0bb. c", "\x0ba. b\x0b",
    "a.\u2028b. c", "\u3000a. b\u3000", "a\x01b. c", "\x01a. b", "a. \x01 b", "a. \u00a0\n", "...  . a", ". a", "a.\r\n\r\nb.", "1.5 mm. b", None,
]


def test_odd_texts_split_as_in_the_sql(spark, duck, tmp_path):
    from cohortine.plans.catalogue import ORACLE, QUERIES

    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duck.cursor() as con:
        con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        sql = {r[0]: r[1:] for r in con.execute(ORACLE["split_sections"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in QUERIES["split_sections"](spark, str(tmp_path)).collect()}
    assert [(ODD[i], got[i], sql[i]) for i in sql if got[i] != sql[i]] == []


def test_sections_of_a_report_still_part(spark, tmp_path):
    from cohortine.plans.catalogue import QUERIES

    text = "Date.  Name.\nFINDINGS:\n One. Two. \n\nIMPRESSION:\nThree. Four. Five."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["split_sections"](spark, str(tmp_path)).first().asDict() == {"doc_id": 1, "n_sentences": 2, "first_md5": hashlib.md5(b"One.").hexdigest()}


def test_the_gate_makes_the_facts_once(spark, folder):
    from cohortine.plans import reporting
    from cohortine.plans.catalogue import QUERIES

    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(QUERIES["roundtrip_gate"](spark, folder)) == scans(reporting.facts(spark, folder))


def test_marks_inside_a_text_are_no_fields(spark):
    text = "FINDINGS:\nA 5 mm calculus (small) in the mid zone of the right kidney is seen.\u0001\u0002upper zone\u00039\u0003large\u0002 \n\nIMPRESSION:\n"
    got = rep.parse_reports(spark.createDataFrame([("m", text)], "case_id string, report string"), "en").first()
    assert [tuple(s) for s in got.right.stones] == [("MID", 5.0, "KUCUK")] and got.left.stones == []
