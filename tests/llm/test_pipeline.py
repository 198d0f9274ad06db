"""The pipeline: its stages on a small table, and their effects."""

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    base = [f"word{i} text{i} of number{i} which is quite unlike the others here and has{i} its{i} own{i} words{i} to tell{i} apart{i} again{i}" for i in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    docs += [(100, base[0], "en", "s", 1), (101, "token = abcdefgh12345678 in words" + base[1][:20], "en", "s", 1), (102, "so one two three four five six seven eight nine ten here", "en", "s", 1), (103, None, "en", "s", None), (104, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == columns
    ids = {r["doc_id"] for r in now.collect()}
    assert ids == {*range(40), 101, 103, 104, None}
    assert "[SECRET]" in spark.read.parquet(f"{sf}/secrets").where("doc_id = 101").first()["text"]
    assert pipeline.run(spark, sf).count() == len(ids)
