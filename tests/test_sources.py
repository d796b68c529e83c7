"""Files, ledgers, gates and the term search."""

import time

from pyspark.sql import functions as F

from cohortine.functions.names import capitals
from cohortine.operators.terms import scan_hits, scan_terms
from cohortine.sources import export, inventory, ledger
from cohortine.streaming.arrivals import collect_arrivals


def test_missing_root_is_skipped(spark, tmp_path):
    (tmp_path / "a" / "p1").mkdir(parents=True)
    (tmp_path / "a" / "p1" / "x.dcm").write_bytes(b"123")
    (tmp_path / "a" / "p1" / "DICOMDIR").write_bytes(b"1")
    (tmp_path / "a" / "p1" / "deep").mkdir()
    (tmp_path / "a" / "p1" / "deep" / "y").write_bytes(b"1")
    files, missing = inventory.list_files(
        spark, [{"id": "r", "path": str(tmp_path / "a"), "collection": "C"}, {"id": "q", "path": str(tmp_path / "none"), "collection": "C"}]
    )
    got = {(r.file_name, r.folder, r.file_size, r.read_error) for r in files.collect()}
    assert got == {("x.dcm", "p1", 3, None), ("y", "deep", 1, None)}
    assert missing == [str(tmp_path / "none")]


def test_predictions_take_their_keys_from_the_end_of_the_name(spark, tmp_path):
    (tmp_path / "e9_s1_sst_has_stone_s42_f3.csv").write_text("kidney_id,prob\nK1,0.25\n", encoding="utf-8-sig")
    (tmp_path / "e9_s1_sst_size3_s7_f0.csv").write_text('kidney_id,prob\nK2,"[0.1, 0.2, 0.7]"\n', encoding="utf-8-sig")
    rows = inventory.read_predictions(spark, str(tmp_path / "*.csv"), "kidney_id string, prob string").collect()
    got = {(r.kidney_id, r.prob, r.config, r.task, r.seed, r.fold) for r in rows}
    assert got == {("K1", "0.25", "e9_s1_sst", "has_stone", 42, 3), ("K2", "[0.1, 0.2, 0.7]", "e9_s1_sst", "size3", 7, 0)}


def test_csv_keeps_quotes_breaks_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc, ğ'), (2, None), (3, "")], "i int, t string")
    inventory.write_csv(df, str(tmp_path / "out"))
    back = inventory.read_csv(spark, str(tmp_path / "out"), "i int, t string")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b"\nc, ğ'), (2, None), (3, "")]


def test_ledger_appends_and_skips(spark, tmp_path):
    plan = ledger.run_grid(spark.createDataFrame([("c", "t", None)], "config string, task string, mirror string"), [1, 2], 2)
    path = str(tmp_path / "runs")
    ledger.append_runs(plan.where("seed = 1").withColumn("auc", F.lit(0.5)), path)
    ledger.append_runs(plan.where("seed = 2 AND fold = 0").withColumn("qwk", F.lit(0.5)), path)
    runs = ledger.read_runs(spark, path)
    assert {"auc", "qwk"} <= set(runs.columns)
    left = ledger.pending(plan, runs, ["config", "task", "mirror", "seed", "fold"]).collect()
    assert [(r.seed, r.fold) for r in left] == [(2, 1)]


def test_gated_export_leaves_the_target_alone_on_a_finding(spark, tmp_path):
    path = str(tmp_path / "public")
    clean, marked = spark.range(3), spark.range(3, 9)
    scan = lambda df: df.where("id = 5")
    assert export.gated_export(marked, scan, path) == {"n_rows": 6, "n_findings": 1, "written": False}
    assert not (tmp_path / "public").exists()
    assert export.gated_export(clean, scan, path) == {"n_rows": 3, "n_findings": 0, "written": True}
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "public").iterdir()}
    assert not export.gated_export(marked, scan, path)["written"]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "public").iterdir()} == before
    assert export.gated_export(spark.range(7, 9), scan, path)["written"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8]
    assert [f.name for f in tmp_path.iterdir()] == ["public"]  # nothing staged is left
    try:
        export.gated_export(clean, lambda df: df.where("absent = 1"), path)
    except Exception:
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8] and [f.name for f in tmp_path.iterdir()] == ["public"]
    else:
        raise AssertionError("the scan must fail")


def test_rebuild_touches_stale_blocks_only(spark, tmp_path):
    path, seen = tmp_path / "table", []

    def build(cases):
        seen.append(None)
        return cases.select("block", "case_id", (F.col("x") * 2).alias("y"))

    def state():
        return {f.parent.name: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}

    rows = [("a b", 1, 1), ("a b", 2, 2), ("c/d", 3, 3), ("e", 4, 4)]
    cases = lambda r: spark.createDataFrame(r, "block string, case_id int, x int")
    blocks = lambda df: sorted(r.block for r in df.collect())
    assert blocks(ledger.rebuild(cases(rows), str(path), "block", "case_id", "1", build)) == ["a b", "c/d", "e"]
    first = state()
    assert blocks(ledger.rebuild(cases(rows), str(path), "block", "case_id", "1", build)) == [] and state() == first
    more = [*rows, ("e", 5, 5)]
    assert blocks(ledger.rebuild(cases(more), str(path), "block", "case_id", "1", build)) == ["e"]
    second = state()
    changed = {k for k in second if second[k] != first.get(k)}
    assert changed == {"block=e"} and len(second) == 3
    # a case that is gone makes its block stale; a block without cases goes
    assert blocks(ledger.rebuild(cases([more[0], *more[3:]]), str(path), "block", "case_id", "1", build)) == ["a b", "c/d"]
    got = sorted((r.block, r.case_id, r.y, r.version) for r in spark.read.parquet(str(path)).collect())
    assert got == [("a b", 1, 2, "1"), ("e", 4, 8, "1"), ("e", 5, 10, "1")]
    assert blocks(ledger.rebuild(cases(more[3:]), str(path), "block", "case_id", "2", build)) == ["a b", "e"]
    assert {r.version for r in spark.read.parquet(str(path)).collect()} == {"2"}


def test_ragged_files_are_united_by_their_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n1,"x\n""y"""\n2,\n', encoding="utf-8-sig")
    (tmp_path / "2.csv").write_text("b,c\n3,4\n")
    (tmp_path / "3.csv").write_text("a,b\n5,6\n")
    (tmp_path / "4.csv").write_text("c\n")
    rows = inventory.read_ragged(spark, str(tmp_path))
    assert sorted(rows.columns) == ["a", "b", "c", "file"]
    got = sorted((r.file, r.a or "", r.b or "", r.c or "") for r in rows.collect())
    assert got == [("1.csv", "1", 'x\n"y"', ""), ("1.csv", "2", "", ""), ("2.csv", "", "3", "4"), ("3.csv", "5", "6", "")]


def test_sheet_rows_are_numbered_across_splits(spark, tmp_path):
    body = [f'{n},"N, {n}",{n % 3}' if n % 7 else f"{n},,0" for n in range(2000)]
    for name in ("x.csv", "y.csv"):
        (tmp_path / name).write_text("\n".join(["Title", "key,name ,key", *body]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = inventory.read_sheet(spark, str(tmp_path), "name ", 1).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kept = [n for n in range(2000) if n % 7]
    assert sorted((r.row_index, r.source_row, r.key, r["name "], r["key.1"]) for r in rows) == sorted(
        (i, n + 2, str(n), f"N, {n}", str(n % 3)) for i, n in enumerate(kept) for _ in range(2)
    )
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "empty.csv").write_text("")
    assert inventory.read_sheet(spark, str(tmp_path / "z"), "name ", 1).count() == 0


def test_predictions_written_by_name_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_s1_zone_s3_f0"), (2, "a_s1_zone_s3_f0"), (3, "b_size3_s7_f4"), (4, "no keys")], "id int, name string")
    inventory.write_predictions(df, str(tmp_path / "p"), "name")
    assert sorted(f.name for f in (tmp_path / "p").iterdir() if not f.name.startswith(".")) == ["a_s1_zone_s3_f0.csv", "b_size3_s7_f4.csv", "no keys.csv"]
    rows = inventory.read_predictions(spark, str(tmp_path / "p" / "*.csv"), "id int")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a_s1", "zone", 3, 0), (2, "a_s1", "zone", 3, 0), (3, "b", "size3", 7, 4)]


def test_term_search_equals_brute_force(spark):
    texts = [(i, f"xx{'ab' * (i % 5)}needle{i % 7}zz" + ("TAG" if i % 3 == 0 else "")) for i in range(60)]
    texts += [(60, ""), (61, "é"), (62, "the same words " * 9_000 + "ü needle number twenty-three"), (63, "needle number twenty-thre")]
    words = [("name", f"needle{k}", k) for k in range(5)] + [("name", "abab", 9), ("tag", "tag", 1), ("tag", "absent", 0)]
    words += [("long", "needle number twenty-three", 7), ("long", "needle number twenty-three", 8), ("odd", "É", 3), ("odd", "z", 5)]
    want = {}
    for i, t in texts:
        for kind, w, n in words:
            if w.upper() in t.upper():
                want[(i, kind)] = min(n, want.get((i, kind), n))
    t = spark.createDataFrame([*texts, (64, None)], "id int, text string").repartition(3)
    w = spark.createDataFrame([*words, ("tag", "", 0), ("tag", None, 0)], "kind string, term string, term_id int")
    for lengths in ((16, 8, 4, 2, 1), (4, 1)):
        rows = scan_terms(t, "id", "text", w, lengths).collect()
        assert {(r.id, r.kind): r.term_id for r in rows} == want and len(rows) == len(want)
    assert scan_terms(t.limit(0), "id", "text", w).isEmpty() and scan_terms(t, "id", "text", w.limit(0)).isEmpty()


def test_term_hits_hold_every_place(spark):
    texts = [(1, "Aaaa é Needle NEEDLEneedle"), (2, "ab" * 70_000 + "needle"), (3, ""), (1, "second row: needle"), (None, "needle"), (4, None)]
    words = [("name", "needle", 3), ("name", "NEEDLE", 2), ("tag", "aa", 1), ("tag", "É", 0), ("uid", "needle needle", 5), ("uid", None, 5)]
    want = set()
    for i, t in texts:
        for kind, w, _ in words:
            if i is not None and t and w:
                low = min(n for k, x, n in words if k == kind and x and x.upper() == w.upper())
                want |= {(i, kind, w.upper(), low, p) for p in range(len(t)) if t.upper().startswith(w.upper(), p)}
    t = spark.createDataFrame(texts, "id int, text string")
    w = spark.createDataFrame(words, "kind string, term string, term_id int")
    rows = [tuple(r) for r in scan_hits(t, "id", "text", w).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_arrivals_are_taken_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(3).write.parquet(src)
    collect_arrivals(spark, src, "id bigint", out, state)
    spark.range(3, 5).write.mode("append").parquet(src)
    collect_arrivals(spark, src, "id bigint", out, state)
    collect_arrivals(spark, src, "id bigint", out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_terms_meet_in_capitals_that_keep_the_places(spark, duck):
    texts = [(1, "Straße: gar weiß ist der Schnee"), (2, "GAR WEISS"), (3, "ﬁn ŉ Gar Weiß"), (4, "ᾳ gar weiẞ"), (5, "Ὀδυσσεύς ΐ")]
    t = spark.createDataFrame(texts, "id int, text string")
    w = spark.createDataFrame([("name", "gar weiß", 1), ("name", "Ὀδυσσεύς", 2), ("name", "ŉ", 3)], "kind string, term string, term_id int")
    got = {(r.id, r.term_id, r.place) for r in scan_hits(t, "id", "text", w).collect()}
    assert got == {(1, 1, 8), (3, 1, 5), (3, 3, 3), (4, 1, 2), (5, 2, 0)}
    points = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF]
    rows = spark.createDataFrame([("a" + c + "ßb",) for c in points], "s string").select("s", capitals(F.col("s")).alias("u")).collect()
    theirs = dict(duck.execute("SELECT s, upper(s) FROM (SELECT unnest(?) AS s)", [[r.s for r in rows]]).fetchall())
    assert [r.s for r in rows if r.u != theirs[r.s]] == [] and all(len(r.u) == len(r.s) for r in rows)


def test_capitals_take_about_as_long_as_upper(spark):
    texts = spark.range(200, numPartitions=8).select(F.repeat(F.lit("Straße, weiß und ﬁn "), 3000).alias("s")).cache()
    texts.count()

    def seconds(how):
        start = time.monotonic()
        texts.select(F.sum(F.length(how(F.col("s"))))).collect()
        return time.monotonic() - start

    upper, ours = (min(seconds(how) for _ in range(2)) for how in (F.upper, capitals))
    assert ours < 8 * upper + 2
