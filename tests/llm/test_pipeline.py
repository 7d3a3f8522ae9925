"""The pipeline's stages on odd rows and on given tables."""

import corpus_pipeline
from feedloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        rows = out.count()
        assert out.columns == docs.columns and 0 < rows <= now.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.filter("not lossless").count() == 0 and last.count() == now.count()


def test_run_is_what_the_stages_give(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.select("doc_id").distinct().count() == got.count() > 100


def test_registered_queries():
    assert [q for q in sorted(queries.all_queries()) if q.startswith("op")] == sorted([
        "op1_quality", "op2_warc", "op3_exact_dedup", "op4_minhash", "op5_secret_scan", "op6_decontaminate", "op7_language",
        "op8_chat_format", "op9_sentencepiece", "op10_lm_score", "op11_neighbours", "op12_merkle", "op13_phrases"])
