"""The pipeline's verdicts hold for rows, not for ids."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gridloom.llm.toxicity import toxicity


def test_verdicts_row_by_row(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = [" ".join(f"{w}{i}" for i in range(30)) for w in ("ant", "bee", "cat", "dog", "elk")]
    hit = "so one two three four five six seven eight nine ten here"
    rows = [(1, own[0]), (1, own[0]), (None, own[0]), (2, own[1]), (2, own[0]), (None, own[2]), (None, own[2]), (None, own[3]), (None, hit), (4, hit), (4, own[4]), (5, None), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    alone = [(1, own[0]), (2, own[1]), (None, own[2]), (None, own[3]), (4, hit), (4, own[4]), (5, None), (5, None), (None, None)]
    assert got(pipeline.drop_near_duplicates(spark, docs, sf)) == sorted(alone, key=repr)
    assert got(pipeline.drop_contaminated(spark, docs, sf)) == sorted([r for r in rows if r[1] != hit], key=repr)

    def marked(docs, network, **more):  # toxic: the texts with an elk or a cat
        return toxicity(docs, network, **more).withColumn("predicted", F.coalesce(F.col("text").rlike("elk|cat"), F.lit(False)).cast("int"))

    monkeypatch.setattr(pipeline, "toxicity", marked)
    assert got(pipeline.drop_toxic(spark, docs, sf)) == sorted([r for r in rows if r[1] not in (own[2], own[4])], key=repr)
