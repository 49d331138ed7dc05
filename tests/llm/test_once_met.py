"""Pairs that no round has tested meet once, however many keys they share; few edges stay in few tasks."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from colloquy.llm import bucket_links, components
from colloquy.llm.bucket_links import Groups, Marks

ROWS = "key long, point long, node long, node_root long, main long, total long, others long"


@pytest.fixture
def made(monkeypatch):
    counts, ordered = [], bucket_links.ordered
    monkeypatch.setattr(bucket_links, "ordered", lambda pairs: counts.append(pairs.count()) or ordered(pairs))
    return counts


def across(spark, mixed):
    """What the last join finds in buckets (key, node) of nodes that are groups of their own, nothing tested before."""
    size = mixed.groupBy("key").agg(F.count("*").alias("total"), F.max("node").alias("main"))
    rows = mixed.join(size, "key").selectExpr("key", "node point", "node", "node node_root", "main", "total", "total - 1 others").to(spark.createDataFrame([], ROWS).schema)
    marks = Marks(mixed.select(F.col("node").alias("point"), "node", F.lit(5).alias("n")).distinct(), ["n"], lambda here, there: F.col(here[0]) == F.col(there[0]))
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    return {tuple(r) for r in bucket_links._across(rows, marks, bucket_links._known(tested, Groups(lambda pairs: pairs))).collect()}


def test_new_pairs_meet_once(spark, made):
    mixed = spark.createDataFrame([(k, n) for k in range(-50, 50) for n in range(12)], "key long, node long")
    assert across(spark, mixed) == set(combinations(range(12), 2))
    assert made[-1] == 66


def test_pairs_that_share_some_keys_all_meet(spark, made):
    buckets = {k: {n for n in range(40) if (k * 7919 + n * n * 31 + k * n) % 5 < 1 + (n > 30)} for k in range(120)}
    buckets |= {1000: {0, 39}, 1001: {1, 2}}  # far above these nodes' least keys
    mixed = spark.createDataFrame([(k, n) for k, ns in buckets.items() for n in ns if len(ns) > 1], "key long, node long")
    wanted = {p for ns in buckets.values() for p in combinations(sorted(ns), 2)}
    assert across(spark, mixed) == wanted
    assert made[-1] < sum(len(ns) * (len(ns) - 1) // 2 for ns in buckets.values()) / 2


def test_of_keys_with_the_same_points_one_stays(spark):
    entries = spark.createDataFrame([(k, n, n) for k in range(20) for n in (1, 2, 3)] + [(k, n, n) for k in (30, 31) for n in (1, 2)], "key long, point long, node long")
    rows = Groups(lambda pairs: pairs).mixed(entries).collect()
    assert sorted((r.key, r.point) for r in rows) == [(0, 1), (0, 2), (0, 3), (30, 1), (30, 2)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (9, 7), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.connected(edges).collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), 3: 3, 7: 3, 9: 3}


def test_few_edges_stay_in_one_task(spark, monkeypatch):
    plans, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    components.connected(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).count()
    assert len(plans) > 3 and not any("Exchange hashpartitioning" in p for p in plans[1:])
