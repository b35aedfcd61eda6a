"""The corpus pipeline on the smallest tables against what its stages promise."""

import os

import corpus_pipeline
from quantloom.llm import common


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.select("doc_id").distinct().count() == sizes[-1] <= sizes[-2]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2]
    assert labels.count() and docs.where("length <= 0 or offset + length > 4096").count() == 0


def folders(spark):
    base = os.path.dirname(common.shared_path(spark, "x")).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_run_leaves_its_result_only(spark, sf_dir):
    before = folders(spark)
    rows = corpus_pipeline.run(spark, sf_dir)
    left = folders(spark) - before
    assert [x.split("-")[0] for x in left] == ["packing"] and rows.count() > 0


def test_scratch_folders_go_with_an_error_too(spark):
    before = folders(spark)
    try:
        with common.scratch(spark):
            common.materialize(spark.range(3), "inside")
            with common.scratch(spark):
                common.materialize(spark.range(3), "deeper")
            assert len(folders(spark) - before) == 1
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
