"""Source records and case records from hand-written rows, and that every kind of privacy hit occurs."""

from pyspark.sql import functions as F

from cohortine.operators import facts
from cohortine.operators import records
from cohortine.plans.catalogue import QUERIES

WIDE = "row int, `1.TAŞ` string, mm1 double, `2.TAŞ ` string, mm2 double, n string, age double, sex string"


def primary(spark, rows):
    df = spark.createDataFrame(rows, WIDE)
    return {r.row: r for r in records.primary_records(df, ["row"], [("1.TAŞ", "mm1"), ("2.TAŞ ", "mm2")], "n", "age", "sex").collect()}


def test_primary_rows(spark):
    got = primary(spark, [
        (1, " SAĞ OR\t", 3.5, "sol alt", None, " Çok ", 41.9, " k"), (2, "At nalı böbrek", 7.0, "kist; hiperdens", 2.0, "2.0", None, None),
        (3, None, None, None, 9.0, "x", 20.0, "e"), (4, None, None, "", None, None, 1.0, "?"),
    ])
    a = got[1]
    assert [(s.stone_index, s.side, s.zone, s.zone_raw, s.zone_inferred, s.size_mm, s.size_known, s.size_class, s.source_column) for s in a.stones] == [
        (1, "RIGHT", "MID", "SAĞ OR", True, 3.5, True, "MIKROLITIYAZIS", "1.TAŞ"), (2, "LEFT", "LOWER", "sol alt", False, None, False, None, "2.TAŞ"),
    ]
    assert (a.anomalies, a.notes, a.stone_count_declared, a.count_qualifier, a.age_years, a.sex, a.sex_source_raw) == ([], ["SAĞ OR"], None, "MANY", 41, "F", "k")
    b = got[2]
    assert (b.stones, b.anomalies, b.notes) == ([], ["COMPLICATED_CYST_HYPERDENSE_LESION", "HORSESHOE_KIDNEY"], ["At nalı böbrek", "kist; hiperdens"])
    assert (b.stone_count_declared, b.count_qualifier, b.age_years, b.sex, b.sex_source_raw) == (2, "EXACT", None, "UNKNOWN", None)
    c = got[3]
    assert [(s.side, s.zone, s.size_class) for s in c.stones] == [("UNKNOWN", "UNKNOWN", "ORTA")] and (c.count_qualifier, c.sex) == ("UNKNOWN", "M")
    assert [(s.side, s.size_known) for s in got[4].stones] == [("UNKNOWN", False)] and got[4].count_qualifier == "UNKNOWN"


def test_secondary_rows(spark):
    df = spark.createDataFrame([
        (1, "Sol üst yerleşimli, 8 mm (Orta boy taş); yorum", "Toplam 12 adet taş", "Hasta: x"), (2, "sağ böbrekte büyüğü alt zonda 6 mm, 2 adet", "adet yok", None), (3, None, None, None),
    ], "row int, b string, s string, t string")
    got = {r.row: r for r in records.secondary_records(df, "row", "b", "s", "t").collect()}
    assert [(x.parsed, x.side, x.zone, x.size_mm, x.raw) for x in got[1].lesions] == [(True, "LEFT", "UPPER", 8.0, "Sol üst yerleşimli, 8 mm (Orta boy taş)"), (False, None, None, None, "yorum")]
    assert (got[1].report_style, got[1].stated, got[1].free.laterality_cue, got[1].free.declared_count) == ("STRUCTURED", 12, None, None)
    assert (got[2].report_style, got[2].lesions, got[2].stated, got[2].free.laterality_cue, got[2].free.largest_mm, got[2].free.declared_count) == ("FREE_TEXT", [], None, "RIGHT", 6.0, 2)
    assert (got[3].report_style, got[3].lesions, got[3].findings_text, got[3].stated) == ("FREE_TEXT", [], None, None)


def cases_of(spark):
    """Case numbers tell what happens to them."""
    wide = spark.createDataFrame([
        (1, "sağ alt", 5.0, None, None, "1", 50.0, "E"), (2, "sağ alt", 5.0, "sol üst", 3.0, "5", 50.0, "K"), (3, "sağ alt", 5.0, None, None, None, 50.0, "E"),
        (4, "sağ alt", 5.0, None, None, "çok", None, None), (6, "kist", 5.0, None, None, "1", None, None),
    ], WIDE)
    p = records.primary_records(wide, ["row"], [("1.TAŞ", "mm1"), ("2.TAŞ ", "mm2")], "n", "age", "sex").withColumnRenamed("row", "case_id")
    text = "sol böbrekte büyüğü üst zonda 7 mm"
    s = spark.createDataFrame([(1, text, "1 adet", "Hasta: A\nX"), (3, text, "4 adet", None), (4, text, None, None), (5, text, "3 adet", None), (6, text, None, None), (2, "iki taraflı", None, None)], "case_id int, b string, s string, t string")
    s = records.secondary_records(s, "case_id", "b", "s", "t")
    flip = F.create_map(F.lit("RIGHT"), F.lit("LEFT"))
    own = F.struct(F.lit("laterality").alias("field"), F.array(F.lit("RIGHT")).alias("primary"), F.lit("BILATERAL").alias("secondary"))
    r = spark.createDataFrame([(1,), (2,), (3,), (7,)], "case_id int").select(
        "case_id", F.when(F.col("case_id") != 2, flip).alias("flip_sides"), F.when(F.col("case_id") == 3, "NONE").alias("force_laterality"),
        F.lit("READ").alias("method"), F.lit("seen").alias("evidence"), own.alias("conflict"),
    )
    cases = spark.createDataFrame([(n, "ARSIV_URETER_TASI" if n in (4, 6) else None) for n in range(1, 8)], "case_id int, collection string")
    return {x.case_id: x for x in records.case_records(cases, p, s, r).collect()}


def test_case_records(spark):
    got = cases_of(spark)
    conflict = lambda x: [(c.field, c.primary, c.secondary, c.resolved) for c in x.conflicts]
    # the cue contradicts the list, and a rule turns the side over
    assert (conflict(got[1]), got[1].steps, got[1].laterality, [s.side for s in got[1].stones]) == ([("stone_side", ["RIGHT"], "LEFT", True)], ["CONFLICT", "FLIPPED"], "LEFT", ["LEFT"])
    assert (got[1].adjudication.method, got[1].original_report.whole, got[1].count_mismatch) == ("READ", "Hasta: 1\nX", False)
    # nothing is wrong, so the rule brings its own conflict
    assert (conflict(got[2]), got[2].steps, got[2].laterality, got[2].count_mismatch, got[2].n_stones_effective, got[2].count_bucket) == ([("laterality", ["RIGHT"], "BILATERAL", True)], ["DECLARED"], "BILATERAL", True, 5, "5-9")
    # the conclusion lends the count, the rule forces the side
    assert (got[3].stone_count_declared, got[3].count_qualifier, got[3].laterality, got[3].steps) == (4, "EXACT", "NONE", ["CONFLICT", "FLIPPED", "FORCED"])
    # an open conflict, many stones, another stone in the ureter
    assert (conflict(got[4]), got[4].n_stones_effective, got[4].count_bucket, got[4].anomalies, got[4].laterality) == ([("stone_side", ["RIGHT"], "LEFT", False)], None, "MANY_UNSPECIFIED", ["URETERAL_STONE_PRESENT"], "BILATERAL")
    # no primary row: the text lends its largest finding, which agrees with the cue
    assert [(s.side, s.zone, s.size_mm, s.zone_inferred, s.source_column) for s in got[5].stones] == [("LEFT", "UPPER", 7.0, True, "free_text")]
    assert (got[5].steps, conflict(got[5]), got[5].stone_count_declared, got[5].stone_count_listed, got[5].sex, got[5].notes) == (["BORROWED"], [], 3, 1, "UNKNOWN", [])
    # an anomaly is no stone, so the text lends one too; a secondary-only anomaly list is sorted
    assert (got[6].steps, got[6].anomalies, got[6].notes) == (["BORROWED"], ["COMPLICATED_CYST_HYPERDENSE_LESION", "URETERAL_STONE_PRESENT"], ["kist"])
    # neither source
    assert (got[7].report_style, got[7].laterality, got[7].stones, got[7].n_stones_effective, got[7].count_bucket, got[7].steps, got[7].free_text_note) == ("ABSENT", "NONE", [], 0, "0", ["FLIPPED", "DECLARED"], None)


def test_every_kind_of_privacy_hit_occurs(spark, folder):
    kinds = {r.kind: r.n for r in QUERIES["phi_scan"](spark, folder).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert {"name", "tag", "filename"} <= set(kinds) and all(kinds.values())


def test_tasks_without_rows_are_counted(spark):
    rows = "has_stone boolean, zone_upper boolean, zone_mid boolean, zone_lower boolean, max_class string, case_id int"
    df = spark.createDataFrame([(True, True, False, False, None, 1), (True, False, False, False, None, 1), (False, False, False, False, None, 2)], rows)
    assert {tuple(r) for r in facts.task_sizes(df, "case_id").collect()} == {("has_stone", 3, 2), ("size3", 0, 0), ("zone", 1, 1)}
