"""The stages of the pipeline, each held against brute force on its own input."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from colloquy.llm import queries, toxicity
from colloquy.llm.common import cut, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark):
    """What goes into each stage, and what comes out of the last."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = [cut(table(spark, SMALL, "documents"))]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], SMALL)))
    return docs


def test_columns(passed):
    assert all(d.columns == passed[0].columns for d in passed[:-1])


def test_toxicity_stage(spark, passed):
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(passed[0], table(spark, SMALL, "labels")).collect()}
    assert sorted(r.doc_id for r in passed[1].collect()) == sorted(i for i, s in scores.items() if s < 0.7)


def test_exact_stage(passed):
    last = {}
    for r in passed[1].collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert sorted(r.doc_id for r in passed[2].collect()) == sorted(last.values())


def test_near_stage(passed):
    from test_exact_results import linked_groups

    groups = linked_groups({r.doc_id: r.text or "" for r in passed[2].collect()}, 5, 80)
    assert sorted(r.doc_id for r in passed[3].collect()) == sorted({c for _, c in groups.values()})


def test_mixing_stage(passed):
    before, after = {r.doc_id for r in passed[3].collect()}, {r.doc_id for r in passed[4].collect()}
    assert after and after <= before


def test_mixing_plan_stays_short(spark, passed):
    """The rates' steps stand over written posteriors: the classifier is not written out in each of them."""
    import corpus_pipeline

    plan = corpus_pipeline.mix_domains(spark, passed[3], SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "UDF" not in plan


def test_encoding_stage(passed):
    library = Tokenizer.from_file(queries.vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in passed[4].collect()}
    rows = passed[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in passed[4].collect())
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
