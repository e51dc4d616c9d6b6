import corpus_pipeline
from panelspark.llm import simhash
from panelspark.llm.queries import QUERIES


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).persist()
        seen[name] = docs.count()
        if name == "quality":
            scored = QUERIES["op4_quality_classifier"](spark, sf).where("predicted = 1")
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in scored.select("doc_id").collect()}
        if name == "line_dedup":
            assert seen[name] == before.count() and docs.where("n_chars <> length(text)").count() == 0
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == seen[name]
            assert simhash.one_of_each(docs).count() == seen[name]
        if name != "encode":
            assert docs.columns == columns
    assert 0 < seen["near_copies"] < seen["quality"] and seen["encode"] == seen["mix"]
    assert corpus_pipeline.run(spark, sf).count() == seen["encode"]


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
