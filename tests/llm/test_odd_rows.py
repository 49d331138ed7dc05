"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, exact_dedup, html_extract, media, mixing, ngram_join, pii, quality, toxicity, url_filter
from colloquy.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, key string, n int, score double, keys string, copies int, rate double, held_out string, __x int"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))


def row(i, text):
    return (i, text, None, None, None, 1, 1, "k", 1, 0.5, "k", 1, 1.0, "h", 1)


ROWS = [row(1, "some plain text of a few words"), row(1, "some plain text of a few words"), row(2, None), row(3, ""), row(4, LONG), row(5, LONG + " end"), row(None, "a text without id"), row(None, None), row(6, "Some plain text of a few words"), row(7, "  \n ")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], LABELS)


def by_id(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=str)


def test_pii(docs, none):
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(none).count() == 0
    assert {r.spans for r in pii.find_pii(docs.where("text IS NULL")).collect()} == {""}


def test_exact_dedup(docs, none):
    found = exact_dedup.find_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    empty = [r for r in found if r.doc_id in (2, 3)]
    assert {r.keep_id for r in empty} == {3} and {r.group_size for r in empty} == {3}
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, None], key=str)
    assert exact_dedup.keep_one(none).count() == 0 and exact_dedup.find_duplicates(none).count() == 0


def test_ngram_join(docs, none):
    found = ngram_join.similar_groups(docs)
    assert by_id(found, "component_id") == sorted([(1, 1), (1, 1), (6, 1), (2, 2), (3, 3), (7, 7), (4, 4), (5, 4), (None, None), (None, None)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert ngram_join.similar_groups(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_bpe(docs, none):
    found = bpe.encode_documents(docs, vocabulary_path())
    assert found.where("decoded = ''").count() == 3 and found.count() == len(ROWS)
    assert bpe.encode_documents(none, vocabulary_path()).count() == 0


def test_toxicity(docs, none, labels):
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_quality(docs, none, labels):
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert quality.score_quality(none, labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).count() == len(ROWS)


def test_mixing(spark, docs, none):
    labelled = spark.createDataFrame([(1, "a"), (4, "b"), (5, "b"), (2, "a"), (None, "a"), (3, None), (4, "c")], "doc_id long, domain string")
    found = mixing.plan_mix(docs, labelled, {"a": 1, "b": 1}).collect()
    assert len(found) == len(ROWS) and all(r.rate >= 0 for r in found)
    assert mixing.mix(docs, labelled, {"a": 1, "b": 1}).columns == docs.columns
    assert mixing.mix(none, labelled, {"a": 1, "b": 1}, fit_docs=docs).count() == 0
    with pytest.raises(ValueError):
        mixing.plan_mix(docs, labelled, {"z": 1})
    with pytest.raises(ValueError):
        mixing.plan_mix(none, labelled, {"a": 1})


def test_url_filter(spark):
    urls = [None, "", "no mark", "http://", "HTTP://WWW.Example.COM", "http://a.net/fr/x?y#z", "x://net", "http://example.com/en/", "http://www.example.com/en/a", "http://notexample.com/en/", "http://é.NET/es/"]
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[4] == ("www.example.com", "", None, "allow")
    assert found[5] == ("a.net", "/fr/x", "net/fr/", "block")
    assert found[7][2:] == ("example.com/en/", "block") and found[8][2:] == ("www.example.com/en/", "allow")
    assert found[9][2:] == ("com/", "allow") and found[10][2:] == ("net/es/", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p", "t"), (4, "u", "<html><body>" + "<div>" * 3000 + "x", "t"), (4, "u", "plain &amp; text", "t"), (None, "u", "<script>var a;</script>", "t")], "page_id long, url string, html string, text string")
    found = html_extract.extract_text(pages)
    assert found.count() == 6 and {r.text for r in found.where("page_id = 1 OR page_id = 2").collect()} == {""}
    assert found.where(F.col("n_chars") != F.length("text")).count() == 0
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_media(spark):
    images = spark.createDataFrame([(1, None, 1), (2, bytearray(b"P5 2 2 255\nabcd"), 1), (3, bytearray(b"rubbish"), 1), (3, bytearray(b"rubbish"), 1), (None, bytearray(b""), 1)], "image_id long, image binary, node int")
    found = media.find_copies(images)
    assert found.count() == 5 and {r.n_corners for r in found.collect()} == {0}
    assert media.find_copies(images.limit(0)).count() == 0
