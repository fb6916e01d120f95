"""The pipeline's stages over the smallest tables."""

import corpus_pipeline
from sievework.llm import registry

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))


def test_stages_keep_arrow_batches_small(spark, tmp_path):
    """Also for what a stage hands back unrun."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 13)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        spark.conf.unset(name)
        dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path))
        assert spark.conf.get(name) == "8m"
    finally:
        spark.conf.set(name, before)
