"""The pipeline's stages one after the other, each held against its operator's plain form."""

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmarks", "private_data", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= kept
        if name != "mixing":
            assert docs.columns == columns
        if name == "language":
            assert now == kept  # all texts have letters of a known language
        if name == "near_duplicates":
            assert docs.count() == docs.select("text").distinct().count()
        if name == "private_data":
            assert docs.where("text LIKE '%@mail%'").count() == 0 and docs.where("n_chars != length(text)").count() == 0
        kept = now
    assert {"domain", "epoch", "n_tokens"} <= set(docs.columns)


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "Und die der das ist nicht.", "de", None, 26), (4, "Write to a@b.com about it all now.", "en", "src1", 34), (4, "Write to a@b.com about it all now.", "en", "src1", 34)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 5, name
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).collect()
