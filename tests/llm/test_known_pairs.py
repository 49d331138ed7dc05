"""Pairs that were tested do not meet again in every key that they share; all others do meet."""

from itertools import combinations

from pyspark.sql import functions as F

from colloquy.llm import bucket_links
from colloquy.llm.bucket_links import Groups, Marks


def test_tested_pairs_do_not_meet_again(spark, monkeypatch):
    made = []
    ordered = bucket_links.ordered
    monkeypatch.setattr(bucket_links, "ordered", lambda pairs: made.append(pairs.count()) or ordered(pairs))
    nodes = range(12)
    mixed = spark.createDataFrame([(k, n, n, n, 0, 12, 11) for k in range(30) for n in nodes], "key long, point long, node long, node_root long, main long, total long, others long")
    marks = Marks(spark.createDataFrame([(n, n, 5) for n in nodes], "point long, node long, n long"), ["n"], lambda here, there: F.col(here[0]) == F.col(there[0]))
    every = set(combinations(nodes, 2))
    rest = {(0, 1), (3, 7), (10, 11)}
    tested = spark.createDataFrame([(a, b, False) for a, b in sorted(every - rest)], "a long, b long, linked boolean")
    known = bucket_links._known(tested, Groups(lambda pairs: pairs))
    found = {tuple(r) for r in bucket_links._across(mixed, marks, known).collect()}
    assert found - (every - rest) == rest
    assert made[-1] < 30 * len(every) / 4


def test_a_node_knows_no_more_than_so_many(spark):
    tested = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.lit(False).alias("linked"))
    rows = {r.node: r.known for r in bucket_links._known(tested, Groups(lambda pairs: pairs)).collect()}
    assert 200 < len(rows[0]) <= bucket_links.KNOWN and rows[7] == [0] and len(rows) == 5000
