"""The pipeline's stages, each on its predecessor's rows."""

from textloom.llm.common import stage, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF))
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns, name
        assert left and left <= ids, name
        ids = left
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in mix.select("doc_id").collect()} == ids


def test_quality_stage_keeps_good_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    kept = corpus_pipeline.quality(spark, table(spark, sf, "documents"), sf).select("doc_id")
    labels = table(spark, sf, "labels")
    lost = labels.filter("quality = 1").join(kept, "doc_id", "left_anti").count()
    stayed = labels.filter("quality = 0").join(kept, "doc_id", "left_semi").count()
    assert lost <= 0.02 * labels.count() and stayed <= 0.02 * labels.count()
