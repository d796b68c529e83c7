"""Parsers on combinations of words, and size bounds."""

import itertools

from pyspark.sql import functions as F

from cohortine.functions import labels as L
from cohortine.functions import names as N
from cohortine.functions import scalars as S
from cohortine.functions import vocab as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


BOUNDS = dict(zip(V.SIZE_CLASSES[1:], V.SIZE_BOUNDS, strict=True))


def test_size_class_changes_at_each_bound(spark):
    """A tenth below, on, and a tenth above each bound; unknown sizes have no class."""
    expected = [(None, None), (float("nan"), None), (0.0, V.SIZE_CLASSES[0])]
    for lower, (upper, bound) in zip(V.SIZE_CLASSES, BOUNDS.items(), strict=False):
        expected += [(bound - 0.1, lower), (float(bound), upper), (bound + 0.1, upper)]
    df = spark.createDataFrame([(m,) for m, _ in expected], "mm double")
    assert [r.c for r in df.select(S.size_class(F.col("mm")).alias("c")).collect()] == [c for _, c in expected]


SIDE_WORDS = {"SAĞ": "RIGHT", "sağ": "RIGHT", "Sağda": "RIGHT", "SA": "RIGHT", "SOL": "LEFT", "solda": "LEFT", "böbrek": "UNKNOWN"}
ZONE_WORDS = {
    "alt": "LOWER", "ÜST": "UPPER", "Orta": "MID", "orta-üst": "MID_UPPER", "ORTA ÜST": "MID_UPPER", "orta-alt": "MID_LOWER", "Orta alt pol": "MID_LOWER", "kaliks": "UNKNOWN",
}
ODD_CELLS = [
    ("\u00a0sol or\t", "LEFT", "MID", True, None, "sol or"), ("at nalı böbrek", "UNKNOWN", "UNKNOWN", False, "HORSESHOE_KIDNEY", "at nalı böbrek"),
    ("çok sayıda, tek büyük taş gibi", "UNKNOWN", "UNKNOWN", False, "MANY_SMALL_STONES_MIMIC_LARGE", "çok sayıda, tek büyük taş gibi"),
    ("sol hiperdens piramis ", "UNKNOWN", "UNKNOWN", False, "HYPERDENSE_PYRAMID_MIMIC", "sol hiperdens piramis"),
    ("SAĞ ALT LEZYON", "UNKNOWN", "UNKNOWN", False, "COMPLICATED_CYST_HYPERDENSE_LESION", "SAĞ ALT LEZYON"),
    ("  ", "UNKNOWN", "UNKNOWN", False, None, None), (None, "UNKNOWN", "UNKNOWN", False, None, None),
]


def test_zone_cells(spark):
    """Every side with every zone, then odd cells; the struct and the plain columns agree."""
    cells = [(f"{s} {z}", side, zone, zone == "UNKNOWN" and side != "UNKNOWN", None, None) for s, side in SIDE_WORDS.items() for z, zone in ZONE_WORDS.items()] + ODD_CELLS
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cells)], "i int, cell string").coalesce(1)
    expected = [c[1:] for c in cells]
    assert [tuple(r.z) for r in df.select("i", L.parse_zone_cell(F.col("cell")).alias("z")).orderBy("i").collect()] == expected
    assert [tuple(r)[2:] for r in L.with_zone(df, F.col("cell")).orderBy("i").collect()] == expected


CUES = {"İki taraflı olarak": "BILATERAL", "Her  iki böbrekte": "BILATERAL", "bilateral": "BILATERAL", "sağ böbrekte": "RIGHT", "Sol böbrek": "LEFT", "sol iki böbrekte": "LEFT", "üreterde": None}
LARGEST = {"büyüğü sol üst zonda 3,5 mm": ("LEFT", "UPPER", 3.5), "Büyüğü sağ alt zonunda 41 mm": ("RIGHT", "LOWER", 41.0), "büyüğü orta zonda 12.25 mm": (None, "MID", 12.25), "taş": ("UNKNOWN", "UNKNOWN", None)}
NUMBERS = {"i2 adet": (12, True), "3 adet": (3, False), "çok adet": (None, False), "2O0adet": (200, True)}


def test_free_texts(spark):
    """Every cue with every largest finding and every count; an unnamed side is that of a one-sided cue."""
    cases = []
    for (c, cue), (g, (side, zone, mm)), (n, (count, repaired)) in itertools.product(CUES.items(), LARGEST.items(), NUMBERS.items()):
        named = side if side is not None else cue if cue in ("RIGHT", "LEFT") else "UNKNOWN"
        cases.append((f"{c} {g}, {n} izlendi", (cue, c == "sol iki böbrekte", named, zone, mm, count, repaired)))
    cases += [("", (None, False, "UNKNOWN", "UNKNOWN", None, None, False)), (None, (None, False, "UNKNOWN", "UNKNOWN", None, None, False))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").coalesce(1)
    assert [tuple(r.f) for r in df.select("i", L.parse_free_text(F.col("t")).alias("f")).orderBy("i").collect()] == [c for _, c in cases]


def test_finding_rows(spark):
    """Parts as they are written, broken by lines, without sizes, and what is no finding."""
    texts = [
        "Sol alt  yerleşimli,  4,5 mm (Küçük taş) ;\n sağ or yerleşimli, boyut yok ( Bilinmiyor );; kontrol;", " ; ", None,
        "at nalı böbrek yerleşimli, 3 mm (x (y))", "SAĞ\nALT yerleşimli, 5 mm (z)", "sol yerleşimli,\u00a07 mm(k)",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i int, t string, side0 string")
    got = [tuple(r) for r in L.finding_rows(df, "t").orderBy("i", "pos").select("i", "pos", "parsed", "zone_raw", "side", "zone", "zone_inferred", "anomaly", "note", "size_mm", "size_text", "size_class_text").collect()]
    blank = (False, *[None] * 9)
    assert got == [
        (0, 0, True, "Sol alt", "LEFT", "LOWER", False, None, None, 4.5, "4,5 mm", "Küçük taş"), (0, 1, True, "sağ or", "RIGHT", "MID", True, None, "sağ or", None, "boyut yok", "Bilinmiyor"), (0, 2, *blank),
        (3, 0, True, "at nalı böbrek", "UNKNOWN", "UNKNOWN", False, "HORSESHOE_KIDNEY", "at nalı böbrek", 3.0, "3 mm", "x (y)"), (4, 0, *blank), (5, 0, True, "sol", "LEFT", "UNKNOWN", True, None, None, 7.0, "7 mm", "k"),
    ]
    raw = [r.raw for r in L.finding_rows(df, "t").where("NOT parsed").orderBy("i").collect()]
    assert raw == ["kontrol", "SAĞ\nALT yerleşimli, 5 mm (z)"]


def test_name_line(spark):
    out = one(spark, "No 7\n\t Hasta  :X Y Z\nBulgular: yok. Hasta iyi.", lambda c: L.mask_name_line(c, F.lit("case-9")))
    assert out == "No 7\nHasta: case-9\nBulgular: yok. Hasta iyi."


def test_names(spark):
    assert one(spark, " Şükrü İnönü-2", N.strip_suffix) == "SUKRUINONU"
    assert one(spark, "Ali Ak BB + üreter taşı", N.strip_suffix) == "ALIAK"
    assert one(spark, "Ali  Ak + hiperdens x", N.strip_suffix) == "ALIAK"
    assert one(spark, "çığ ÖŞ", N.fold) == "CIGOS"


def test_count_cells(spark):
    get = lambda v: tuple(one(spark, v, L.declared_count))
    assert [get(v) for v in ("3.0", "çok sayıda", "?", None, "nan", "7")] == [
        (3, "EXACT"), (None, "MANY"), (None, "UNKNOWN"), (None, "UNKNOWN"), (None, "UNKNOWN"), (7, "EXACT"),
    ]


def test_windows_round_half_to_even(spark):
    assert one(spark, 240, lambda c: S.window8(c, 40, 400), "int") == 255
    assert one(spark, -5000, lambda c: S.encode_offset(c), "int") is None
    assert one(spark, -4096, lambda c: S.decode_offset(S.encode_offset(c)), "int") == -4096


def test_ordinal_decode_keeps_the_order(spark):
    df = spark.createDataFrame([(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-1.0, 5.0)], "a double, b double")
    cls, p = S.ordinal_decode(F.col("a"), F.col("b"))
    rows = df.select(cls.alias("c"), p.alias("p")).collect()
    assert [r.c for r in rows] == [0, 1, 2, 0]
    assert all(abs(sum(r.p) - 1) < 1e-12 and min(r.p) >= 0 for r in rows)


def test_findings_are_split_at_a_plain_character(spark):
    df = spark.createDataFrame([(1, " ; a ;\u3000; b;c d ;;"), (2, ";"), (3, None), (4, "x")], "k int, t string")
    rows = L.finding_rows(df, "t")
    assert sorted((r.k, r.pos, r.raw) for r in rows.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c d"), (4, 0, "x")]
    assert "\u3000]*" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_equal_finding_texts_are_read_once(spark, folder):
    from cohortine.plans import checked

    every = checked.finding_text(spark, folder).select("text")
    read = checked.lesions(spark, folder).where("pos = 0")
    n_texts, n_rows = every.distinct().count(), every.count()
    assert n_texts < n_rows
    assert (read.count(), read.agg(F.sum("n")).first()[0]) == (n_texts, n_rows)
