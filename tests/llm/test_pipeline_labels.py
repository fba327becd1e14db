import corpus_pipeline
import pytest

from terrastack.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def write(spark, folder, labels):
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(20)], [(i, 0, 1) for i in range(20)]], ids=["none", "good", "bad"])
@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage])
def test_all_stay_without_examples_of_both_labels(spark, tmp_path, stage, labels):
    write(spark, tmp_path, labels)
    docs = spark.createDataFrame([(i, f"clean words of text {i}") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == set(range(20))


def test_labels_of_absent_documents_take_no_share(spark, tmp_path):
    write(spark, tmp_path, [(i, 1, i % 2) for i in range(400)])
    docs = spark.createDataFrame([(i, "long " * 50 if i < 30 else f"word{i}") for i in range(60)], "doc_id long, text string")
    sample = quality.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", 1_000_003, 5, 20).collect()
    assert len(sample) == 20 and sum(r.label_ for r in sample) == 10
    assert all(0 <= r.doc_id < 60 for r in sample)
