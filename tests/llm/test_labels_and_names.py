"""The labeller without telling marks, rule lists of several tries, keys and tokens, and columns with any names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, exact_dedup, html_extract, mixing, ngram_join, pii, quality, toxicity, url_filter
from colloquy.llm.labelled import smallest_hashes, smallest_ids
from colloquy.llm.queries import vocabulary_path


def test_blocks_without_landmarks_and_names(spark):
    """Fitted on 100 pages: other pages with landmarks and telling names taken away, as they are and in frames with
    notices, side columns, forms and comments in and around the article."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy(F.xxhash64("page_id")).collect()]
    blocks = [html_extract.blocks_of(h) for h in pages]
    model, rng = html_extract.fit_labeller(blocks[:100]), np.random.default_rng(5)
    others = [(b, html_extract.teacher(b)) for b in blocks[100:]]
    framed = [html_extract.varied(b, y, rng) for b, y in others]
    for cases, least in ((others, 0.95), (framed, 0.9)):
        found = model.label([html_extract.hidden(b) for b, _ in cases])
        hits = sum((f & (y > 0)).sum() for f, (_, y) in zip(found, cases))
        precision, recall = hits / sum(f.sum() for f in found), hits / sum(y.sum() for _, y in cases)
        print("precision", precision, "recall", recall)
        assert precision >= least and recall >= least


def test_html_query_by_brute_force(spark):
    """Every page labelled alone gives the registered text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_extract.train(pages)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract_text(pages).collect():
        blocks = html_extract.blocks_of(html[r.page_id])
        assert r.text == "\n".join(b[1] for b, y in zip(blocks, model.label([blocks])[0]) if y)


def test_deep_paths_keep_their_middle():
    page = "<div>" * 60 + "<section class=comments>" + "<div>" * 60 + "<p>x"
    assert ".comments" in html_extract.blocks_of(page)[0][0]


def test_rules_of_several_tries(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    whole = sorted(map(tuple, url_filter.judge_urls(pages).collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert sorted(map(tuple, url_filter.judge_urls(pages).collect())) == whole


def test_keys_and_tokens():
    spans = lambda t: [t[s.start : s.end] for s in pii.find_spans(t) if s.kind == "secret"]
    assert spans('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" API_KEY: abcdef123456789') == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "abcdef123456789"]
    assert spans("a token of love, the secret agreements of everybody, password: short1") == []


@pytest.mark.parametrize("bound, rows", [(10, 1000), (10, 5), (700, 1000)])
def test_smallest_ids(spark, bound, rows):
    ids = spark.range(rows).select((F.col("id") % 400).alias("id"))
    assert smallest_ids(ids, "id", bound).collect() == smallest_hashes(ids.distinct(), "id", bound).collect()


def test_any_column_names(spark):
    """Names of the operators' own columns, and an id and a text with a space."""
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "`my id` long, quality int, toxic int")
    docs = spark.createDataFrame([(k, f"text number {k} " * 9, 1, 2, "x", 3.0, 4) for k in range(12)] * 2, "`my id` long, `a text` string, __recipe int, __sha int, __score string, __tokens double, ___p0 int")
    domains = labels.select("my id", F.when(F.col("toxic") == 1, "a").otherwise("b").alias("domain"))
    assert exact_dedup.keep_one(docs, "my id", "a text").columns == docs.columns and exact_dedup.keep_one(docs, "my id", "a text").count() == 12
    assert ngram_join.keep_one(docs, "my id", "a text").columns == docs.columns
    assert toxicity.drop_toxic(docs, labels, "my id", "a text").columns == docs.columns
    assert mixing.mix(docs, domains, {"a": 1, "b": 1}, "my id", "a text").columns == docs.columns
    for found in (pii.find_pii(docs, "my id", "a text"), bpe.encode_documents(docs, vocabulary_path(), "my id", "a text"), toxicity.score_toxicity(docs, labels, "my id", "a text")):
        assert found.columns[0] == "my id" and found.count() == 24
    renamed = docs.withColumnRenamed("a text", "text")
    assert quality.score_quality(renamed.withColumnRenamed("my id", "id"), labels.withColumnRenamed("my id", "id"), "id").count() == 24
