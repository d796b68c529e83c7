"""Sources, sinks, ledgers and public copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortine.functions import vocab as V
from cohortine.operators.ordering import running_totals
from cohortine.operators.terms import scan_terms
from cohortine.plans.grouped import DET
from cohortine.plans.registry import query
from cohortine.plans.rows import SIZE_CASE, kidneys
from cohortine.sources import export, inventory, ledger
from cohortine.sources import fixtures as fx
from cohortine.sources.fixtures import with_views
from cohortine.sources.tables import table


@query("file_inventory")
def _(spark, folder):
    files, _missing = inventory.list_files(
        spark, [{"id": "given", "path": folder, "collection": "TABLES"}, {"id": "absent", "path": f"{folder}/no-such-root", "collection": "NONE"}]
    )
    return files.select("root_id", "collection", "folder", "file_name", "file_size", "read_error")


@query(
    "path_fields",
    """SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS file_name, regexp_extract(url, '([^/]+)/[^/]+$', 1) AS folder FROM pages""",
)
def _(spark, folder):
    fields = inventory.path_fields(F.col("url"))
    return table(spark, folder, "pages").select("page_id", *[c.alias(n) for n, c in fields.items()])


@query(
    "multi_root_union",
    """SELECT root_id, collection, count(*) AS n, sum(n)::BIGINT AS n_chars, count(lang) AS n_lang FROM (SELECT 'a' AS root_id, 'DOCUMENTS' AS collection, length(text) AS n, lang FROM documents
      UNION ALL SELECT 'b', 'CONVERSATIONS', length(text), NULL FROM conversations UNION ALL SELECT 'c', 'PAGES', length(html), NULL FROM pages) GROUP BY ALL""",
)
def _(spark, folder):
    d = table(spark, folder, "documents").select("text", "lang")
    c = table(spark, folder, "conversations").select("text")
    p = table(spark, folder, "pages").select(F.col("html").alias("text"))
    u = inventory.union_roots({"a": ("DOCUMENTS", d), "b": ("CONVERSATIONS", c), "c": ("PAGES", p), "d": ("MISSING", None)})
    return u.groupBy("root_id", "collection").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count("lang").alias("n_lang")
    )


@query("csv_roundtrip", "SELECT conv_id, turn, role, md5(text) AS text_md5, length(text) AS n FROM conversations")
def _(spark, folder):
    c = table(spark, folder, "conversations")
    path = f"{inventory.scratch_folder(spark)}/conversations"
    inventory.write_csv(c, path)
    back = inventory.read_csv(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("n")
    )


@query(
    "keyed_rows",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey AS source_row, 'P' || o_custkey AS name FROM orders WHERE o_custkey % 11 > 0""",
)
def _(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("source_row"),
        F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("name"),
    )
    kept = o.where(F.col("name").isNotNull()).withColumn("one", F.lit(1))
    return running_totals(kept, [], "source_row", ["one"]).select((F.col("cum_one") - 1).alias("row_index"), "source_row", "name")


@query(
    "case_documents",
    with_views("f_case", "f_stone", "f_kidney", body="""SELECT c.case_id, c.patient_id, c.study_date, c.site, r.has_stone AS right_has_stone, r.max_mm AS right_max_mm, l.has_stone AS left_has_stone, l.max_mm AS left_max_mm,
      l.dominant_zone AS left_zone, r.n_characterized + l.n_characterized AS n FROM f_case c JOIN f_kidney r ON r.case_id = c.case_id AND r.side = 'RIGHT' JOIN f_kidney l ON l.case_id = c.case_id AND l.side = 'LEFT'"""),
)
def _(spark, folder):
    k = kidneys(spark, folder)
    block = F.struct("has_stone", "n_characterized", "max_mm", "max_class", "dominant_zone")
    sides = k.groupBy("case_id", "patient_id", "study_date", "site").agg(
        F.max(F.when(F.col("side") == "RIGHT", block)).alias("right"), F.max(F.when(F.col("side") == "LEFT", block)).alias("left")
    )
    text = ledger.document_text(
        {
            "case_id": F.col("case_id"), "patient_id": F.col("patient_id"),
            "cohort": F.struct("study_date", F.col("site").alias("collection")),
            "targets": F.struct(F.struct("right", "left").alias("kidneys")),
        }
    )
    side = "struct<has_stone:boolean,n_characterized:bigint,max_mm:double,max_class:string,dominant_zone:string>"
    schema = f"case_id bigint, patient_id bigint, cohort struct<study_date:string,collection:string>, targets struct<kidneys:struct<right:{side},left:{side}>>"
    doc = sides.select(F.from_json(text, schema).alias("d"))
    kid = "d.targets.kidneys"
    return doc.select(
        "d.case_id", "d.patient_id", "d.cohort.study_date", F.col("d.cohort.collection").alias("site"),
        F.col(f"{kid}.right.has_stone").alias("right_has_stone"), F.col(f"{kid}.right.max_mm").alias("right_max_mm"),
        F.col(f"{kid}.left.has_stone").alias("left_has_stone"), F.col(f"{kid}.left.max_mm").alias("left_max_mm"),
        F.col(f"{kid}.left.dominant_zone").alias("left_zone"), (F.col(f"{kid}.right.n_characterized") + F.col(f"{kid}.left.n_characterized")).alias("n"),
    )


@query(
    "runs_from_filenames",
    """SELECT event_id, 'e9_s1_' || event_type || '_sst' AS config, CASE event_id % 3 WHEN 0 THEN 'has_stone' WHEN 1 THEN 'size3' ELSE 'zone' END AS task,
      CAST(user_id AS INTEGER) AS seed, CAST(event_id % 5 AS INTEGER) AS fold FROM events""",
)
def _(spark, folder):
    e = table(spark, folder, "events")
    task = fx.word_by(F.col("event_id") % 3, ["has_stone", "size3", "zone"])
    name = F.concat(
        F.lit("e9_s1_"), "event_type", F.lit("_sst_"), task, F.lit("_s"), F.col("user_id").cast("string"),
        F.lit("_f"), (F.col("event_id") % 5).cast("string"), F.lit(".csv"),
    )
    return e.select("event_id", *[c.alias(n) for n, c in inventory.run_keys(name).items()])


@query(
    "pending_cells",
    with_views("f_run", body="""WITH c AS (SELECT DISTINCT config, 'has_stone' AS task, 'sst' AS model, 'stone' AS input, 'bce' AS form, CASE WHEN config <> 'view' THEN 'on' END AS mirror FROM f_run),
        p AS (SELECT c.*, s AS seed, f AS fold FROM c, range(6) a(s), range(5) b(f))
      SELECT config, task, model, input, form, mirror, seed::INTEGER AS seed, fold::INTEGER AS fold FROM p WHERE NOT EXISTS (SELECT 1 FROM f_run r WHERE r.config = p.config AND r.seed = p.seed AND r.fold = p.fold AND r.metric > 48)"""),
)
def _(spark, folder):
    keys = [F.lit("has_stone").alias("task"), F.lit("sst").alias("model"), F.lit("stone").alias("input"), F.lit("bce").alias("form")]
    mirror = F.when(F.col("config") != "view", "on").alias("mirror")
    runs = fx.runs(spark, folder)
    planned = ledger.run_grid(runs.select("config", *keys, mirror).distinct(), [0, 1, 2, 3, 4, 5], V.N_FOLDS)
    done = runs.where("metric > 48").select("config", *keys, mirror, "seed", "fold")
    return ledger.pending(planned, done)


@query(
    "stale_cases",
    with_views("f_case", body="SELECT case_id FROM f_case WHERE case_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 0)"),
)
def _(spark, folder):
    built = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") % 2 == 0, "1.1.0").otherwise("1.0.0").alias("version")
    )
    return ledger.stale(fx.cases(spark, folder).select("case_id"), built, "case_id", "1.1.0")


@query(
    "rebuilt_cases",
    with_views("f_case", body="""SELECT site, case_id, CASE WHEN site IN ('2-HIGH', '4-NOT SPECIFIED', '5-LOW') THEN '1.1.0' ELSE '1.2.0' END AS version, 'D' || study_date AS label FROM f_case
      WHERE site <> '4-NOT SPECIFIED' OR case_id % 2 = 0"""),
)
def _(spark, folder):
    """Two sites are out of date: one has new cases, one was built by an older version; the others keep their files."""
    c = fx.cases(spark, folder)
    build = lambda d: d.select("site", "case_id", F.concat(F.lit("D"), "study_date").alias("label"))
    path = f"{inventory.scratch_folder(spark)}/cases"
    some = c.where("site <> '4-NOT SPECIFIED' OR case_id % 2 = 0")
    ledger.rebuild(some.where("site <> '3-MEDIUM'"), path, "site", "case_id", "1.1.0", build)
    old = F.col("site").isin("1-URGENT", "3-MEDIUM")
    ledger.rebuild(some.where(old), f"{path}-new", "site", "case_id", "1.2.0", build)
    kept = spark.read.parquet(path).where(~old)
    return kept.unionByName(spark.read.parquet(f"{path}-new")).select("site", "case_id", "version", "label")


@query(
    "ragged_union",
    """SELECT 'a' AS part, conv_id::VARCHAR AS conv_id, role, NULL AS text_md5, turn::VARCHAR AS turn FROM conversations WHERE conv_id % 3 = 0
    UNION ALL SELECT 'b', conv_id::VARCHAR, NULL, md5(text), turn::VARCHAR FROM conversations WHERE conv_id % 3 = 1 UNION ALL SELECT 'c', conv_id::VARCHAR, role, md5(text), NULL FROM conversations WHERE conv_id % 3 = 2""",
)
def _(spark, folder):
    """Three headers in one folder; the texts hold line breaks and quotes."""
    c, path = table(spark, folder, "conversations"), inventory.scratch_folder(spark)
    for rest, columns in enumerate((["conv_id", "turn", "role"], ["text", "conv_id", "turn"], ["role", "conv_id", "text"])):
        inventory.write_csv(c.where(F.col("conv_id") % 3 == rest).select(*columns), f"{path}/part={'abc'[rest]}")
    back = inventory.read_ragged(spark, f"{path}/part=*/*.csv")
    part = F.when(F.col("role").isNull(), "b").when(F.col("text").isNull(), "a").otherwise("c")
    return back.select(part.alias("part"), "conv_id", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "turn")


@query(
    "sheet_rows",
    """SELECT o_orderkey AS source_key, count(*) OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS row_index, 'P' || o_custkey || ', "x"' AS name, o_orderstatus AS status FROM orders WHERE o_custkey % 11 > 0""",
)
def _(spark, folder):
    """Sheets with two lines above their header; rows without a name are dropped, the others keep their order."""
    o = table(spark, folder, "orders")
    name = F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit('"P'), F.col("o_custkey").cast("string"), F.lit(', ""x"""'))).otherwise("")
    body = o.select((F.col("o_orderkey") % 4).alias("sheet"), "o_orderkey", F.concat_ws(",", "o_orderkey", name, "o_orderstatus").alias("value"))
    lines = [(-3, "A title"), (-2, ""), (-1, "key,AD SOYAD,status")]
    top = spark.createDataFrame([(sheet, *line) for sheet in range(4) for line in lines], "sheet long, o_orderkey long, value string")
    path = f"{inventory.scratch_folder(spark)}/sheet"
    ordered = body.union(top).repartition("sheet").sortWithinPartitions("sheet", "o_orderkey").select("sheet", "value")
    ordered.write.partitionBy("sheet").text(path)
    rows = inventory.read_sheet(spark, f"{path}/sheet=*", "AD SOYAD", 2)
    return rows.select(F.col("key").cast("bigint").alias("source_key"), "row_index", F.col("AD SOYAD").alias("name"), "status")


@query(
    "prediction_rows",
    """SELECT 'e9_s1_' || event_type || '_sst' AS config, 'size3' AS task, CAST(user_id % 5 AS INTEGER) AS seed, CAST(day(ts) % 5 AS INTEGER) AS fold, event_id, round(value, 2) AS prob FROM events""",
)
def _(spark, folder):
    """One file for each run, named by its keys; the keys come back from the names."""
    e = table(spark, folder, "events")
    name = F.concat(F.lit("e9_s1_"), "event_type", F.lit("_sst_size3_s"), (F.col("user_id") % 5).cast("string"), F.lit("_f"), (F.dayofmonth("ts") % 5).cast("string"))
    path = f"{inventory.scratch_folder(spark)}/predictions"
    inventory.write_predictions(e.select("event_id", F.round("value", 2).alias("prob"), name.alias("name")), path, "name")
    back = inventory.read_predictions(spark, f"{path}/*.csv", "event_id bigint, prob double")
    return back.select("config", "task", "seed", "fold", "event_id", "prob")


@query(
    "gated_export",
    """WITH d AS (SELECT count(DISTINCT d.doc_id) AS n FROM documents d JOIN benchmark b ON contains(upper(d.text), upper(b.text))), p AS (SELECT count(*) AS n FROM orders o JOIN benchmark b ON contains(upper(o.o_orderpriority), upper(b.text)))
    SELECT 'documents' AS batch, d.n AS n_findings, CASE WHEN d.n = 0 THEN (SELECT count(*) FROM documents) ELSE 0 END AS n_written FROM d UNION ALL SELECT 'orders', p.n, CASE WHEN p.n = 0 THEN (SELECT count(*) FROM orders) ELSE 0 END FROM p""",
)
def _(spark, folder):
    """Documents hold passages of the benchmark and are held back; orders hold none and are written."""
    words = table(spark, folder, "benchmark").select(F.lit("passage").alias("kind"), F.col("text").alias("term"), F.col("item_id").alias("term_id"))
    batches = {"documents": ("doc_id", "text"), "orders": ("o_orderkey", "o_orderpriority")}
    path, out = inventory.scratch_folder(spark), []
    for name, (key, text) in batches.items():
        rows = table(spark, folder, name)
        state = export.gated_export(rows, lambda d, key=key, text=text: scan_terms(d, key, text, words), f"{path}/{name}")
        out.append((name, state["n_findings"], spark.read.parquet(f"{path}/{name}").count() if state["written"] else 0))
    return spark.createDataFrame(out, "batch string, n_findings long, n_written long")


@query(
    "public_projection",
    """SELECT substr(sha256('salt' || o_orderkey), 1, 16) AS series_uid_hash, substr(sha256('salt' || o_custkey), 1, 16) AS study_uid_hash, o_orderpriority AS collection, o_orderstatus AS status FROM orders""",
)
def _(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("series_instance_uid"), F.col("o_custkey").alias("study_instance_uid"),
        F.col("o_orderkey").cast("string").alias("patient_folder"), F.col("o_orderpriority").alias("collection"), F.col("o_orderstatus").alias("status"),
    )
    return export.public_projection(o, {"series_instance_uid": "series_uid_hash", "study_instance_uid": "study_uid_hash"}, "salt")


@query(
    "dataset_manifest",
    with_views("f_case", "f_stone", "f_kidney", body="""SELECT 'cohort' AS section, 'n_rows' AS key, count(*) AS n FROM f_kidney UNION ALL SELECT 'cohort', 'n_patients', count(DISTINCT patient_id) FROM f_kidney
      UNION ALL SELECT 'cohort', 'n_cases', count(DISTINCT case_id) FROM f_kidney UNION ALL SELECT 'side', side, count(*) FROM f_kidney GROUP BY side UNION ALL SELECT 'max_class', coalesce(max_class, 'missing'), count(*) FROM f_kidney GROUP BY 2
      UNION ALL SELECT 'dominant_zone', dominant_zone, count(*) FROM f_kidney GROUP BY 2"""),
)
def _(spark, folder):
    return export.manifest(kidneys(spark, folder), ["side", "max_class", "dominant_zone"], "patient_id", "case_id")


@query(
    "manifest_document",
    with_views("f_case", "f_stone", "f_kidney", body="""SELECT '{' || string_agg('"' || side || '":' || n, ',' ORDER BY side) || '}' AS side_counts FROM (SELECT side, count(*) AS n FROM f_kidney GROUP BY side)"""),
)
def _(spark, folder):
    rows = export.manifest(kidneys(spark, folder), ["side", "max_class"], "patient_id", "case_id")
    return export.manifest_document(rows).select(F.col("manifest")["side"].alias("side_counts"))


@query(
    "export_gate",
    """WITH h AS (SELECT count(DISTINCT d.doc_id) AS n FROM documents d JOIN benchmark b ON contains(upper(d.text), upper(b.text))) SELECT n AS n_findings, n = 0 AS clean FROM h""",
)
def _(spark, folder):
    words = table(spark, folder, "benchmark").select(F.lit("passage").alias("kind"), F.col("text").alias("term"), F.col("item_id").alias("term_id"))
    return export.gate(scan_terms(table(spark, folder, "documents"), "doc_id", "text", words))


@query(
    "block_merge",
    with_views("f_case", "f_stone", "f_kidney", body="""SELECT case_id, side, CASE WHEN case_id % 3 = 0 THEN 'segmentation' WHEN has_stone THEN 'heuristic' WHEN case_id % 3 = 1 THEN 'none' END AS source,
      CASE WHEN case_id % 3 = 0 THEN 1.5::DOUBLE WHEN has_stone THEN max_mm WHEN case_id % 3 = 1 THEN 0.0::DOUBLE END AS size FROM f_kidney"""),
)
def _(spark, folder):
    k = kidneys(spark, folder).withColumn("key", F.concat_ws("_", "case_id", "side"))
    m = F.col("case_id") % 3
    crop = F.when(m == 0, F.struct(F.lit("segmentation").alias("source"), F.lit(1.5).alias("size"))).when(
        m == 1, F.struct(F.lit("none").alias("source"), F.lit(0.0).alias("size"))
    )
    docs = k.select("key", "case_id", "side", crop.alias("crop"))
    updates = k.where("has_stone").select("key", F.struct(F.lit("heuristic").alias("source"), F.col("max_mm").alias("size")).alias("crop"))
    return ledger.merge_block(docs, updates, "key", "crop", "segmentation").select("case_id", "side", "crop.source", "crop.size")
