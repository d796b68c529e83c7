import corpus_pipeline
from cohortine.llm import decontaminate, jaccard


def test_stages(spark, docs, rows, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(1, " ".join(r[1].split()[:12])) for r in rows if r[0] == 4 and r[1]][:1], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    docs.write.parquet(path + "/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    now = docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, path)
        out.write.parquet(f"{path}/{at}")
        out = spark.read.parquet(f"{path}/{at}")
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= now.count()
        if name == "near_duplicates":
            left = jaccard.similar_documents(out)
            assert left.where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert decontaminate.contamination_report(out, spark.read.parquet(path + "/benchmark.parquet")).where("contaminated").count() == 0
        now = out
    assert set(now.columns) == {"doc_id", "piece", "first_word", "n_words", "bucket_len", "batch", "slot"} and now.count() > 30


def test_stages_take_empty_tables_and_odd_names(spark, docs, rows, tmp_path):
    """No documents, no benchmark, and columns whose names need quoting."""
    path = str(tmp_path / "sf")
    spark.createDataFrame([], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    odd = docs.where("doc_id < 12 OR doc_id IS NULL").withColumnRenamed("key", "a.b").withColumnRenamed("id", "c`d")
    odd = odd.withColumnRenamed("drops", "component_id")
    for name, stage in corpus_pipeline.STAGES:
        for given in (odd, odd.where("false")):
            out = stage(spark, given, path)
            if name != "packing":
                assert out.columns == odd.columns, name
            assert out.count() <= (10**6 if name == "packing" else given.count()) and (given is odd or out.isEmpty())
