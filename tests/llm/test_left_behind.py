"""What the stages of the pipeline leave in the shared folder."""

from pathlib import Path

from colloquy.llm import ngram_join
from colloquy.llm.common import cut, cut_alone, shared_folder, table

SMALL = "/root/testdata/sf0.001"


def folders(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file://")).iterdir()}


def test_only_the_result_stays(spark):
    before = folders(spark)

    def make():
        cut(spark.range(3))
        inner = cut_alone(lambda: cut(spark.range(5)).where("id > 1"))
        return inner.where("id > 2")

    found = cut_alone(make)
    assert sorted(r.id for r in found.collect()) == [3, 4] and len(folders(spark) - before) == 1


def test_near_stage_leaves_one_table(spark):
    docs, before = table(spark, SMALL, "documents"), folders(spark)
    kept = ngram_join.keep_one(docs)
    assert len(folders(spark) - before) == 1
    whole = ngram_join.similar_groups(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.component_id for r in whole.select("component_id").distinct().collect())


def test_pipeline_leaves_its_last_input(spark):
    import corpus_pipeline

    before = folders(spark)
    found = corpus_pipeline.run(spark, SMALL)
    assert len(folders(spark) - before) == 1 and found.count() > 0
