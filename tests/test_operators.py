"""Small cases with known outcomes for operators that SQL does not express."""


import numpy as np
import pytest

from colloquy.config import Settings
from colloquy.functions import text
from colloquy.operators import clustering, intervals, relational, state
from colloquy.streaming import folds


@pytest.mark.parametrize(
    "vectors, distance, clusters",
    [
        ([[1, 0], [0, 1]], 0.4, [0, 1]),
        ([[1, 0], [0.999, 0.044]], 0.4, [0, 0]),
        ([[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [0, 0.99, 0.1], [0, 0, 1]], 0.4, [0, 0, 1, 1, 2]),
        ([[1, 0], [0, 1], [0.99, 0.14]], 0.4, [0, 1, 0]),
        ([[0, 0]], 0.4, [0]),
    ],
)
def test_merge_closest(vectors, distance, clusters):
    assert clustering.merge_closest(np.array(vectors), distance) == clusters


def test_follow_leaders():
    vectors = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.95, 0.05]])
    assert clustering.follow_leaders(vectors, 0.5) == [0, 0, 1, 0]


def continued(events, window=15_000):
    now, out = folds.Speaking(), []
    for at, evidence, speaker in events:
        now, made = folds.continue_speaker(now, at, evidence, speaker, window)
        out.append(made)
    return out


def test_continuity():
    assert continued([(0, "unknown", None)]) == [(None, None, False)]
    assert continued([(0, "confirmed", "a"), (5_000, "unknown", None)])[1] == ("a", "tentative", True)
    assert continued([(0, "confirmed", "a"), (20_000, "unknown", None)])[1] == (None, None, False)
    two = continued([(0, "confirmed", "a"), (1_000, "tentative", "b"), (2_000, "tentative", "b")])
    assert two[1][0] == "a" and two[2][0] == "b"
    assert continued([(0, "confirmed", "a"), (5_000, "unknown", None)], window=0)[1] == (None, None, False)
    assert continued([(9_000, "confirmed", "a"), (5_000, "unknown", None)])[1] == (None, None, False)


def closed(events):
    now, out = folds.Recording(), []
    for kind, start, end in events:
        now, clip = folds.watch_boundary(now, kind, start, end, Settings())
        out.append(clip)
    return out


def test_boundaries():
    assert closed([("speech", 0, 2_000), ("speech", 280_000, 290_000), ("silence", 301_500, 301_500)])[-1] == (0, 290_000)
    assert closed([("speech", 0, 300_500), ("silence", 300_700, 300_700)]) == [None, None]
    assert closed([("speech", 0, 360_500)]) == [(0, 360_500)]
    assert closed([("mute", 5, 5)]) == [None]
    assert closed([("speech", 0, 100), ("mute", 200, 200)])[-1] == (0, 100)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, s * 10 + k, k * 4_000, ("confirmed", "tentative", "unknown")[(s + k) % 3], None if (s + k) % 3 == 2 else f"v{k % 2}") for s in range(3) for k in range(8)]
    schema = "session_id long, id long, end_ms long, evidence string, speaker_id string"
    spark.createDataFrame(rows[:], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = folds.stream_continuity(stream).writeStream.format("memory").queryName("heard").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = folds.attribute_continuity(spark.createDataFrame(rows, schema))
    assert sorted(spark.table("heard").collect(), key=str) == sorted(batch.collect(), key=str)


@pytest.mark.parametrize(
    "answer, items",
    [
        ('{"items": [{"a": 1}]}', [{"a": 1}]),
        ('[{"a": 1}]', [{"a": 1}]),
        ('<think>{"items": []}</think>Sure: {"todos": [{"b": "}"}]}', [{"b": "}"}]),
        ('```json\n{"items": [{"a": 2}]}\n```', [{"a": 2}]),
        ('{"items": [{"a": 1}]} or {"items": [{"a": 3}]}', [{"a": 3}]),
        ("nothing", []),
        (None, []),
    ],
)
def test_recover_items(answer, items):
    assert text.recover_items(answer) == items


def test_excerpt(spark):
    texts = ["short", "é" * 200, "x" * 281, None]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.excerpt(F.col("t")).alias("e")).collect()
    assert [r.e for r in rows] == ["short", "é" * 140 + "…", "x" * 280 + "…", None]


def test_windows(spark):
    latest = spark.createDataFrame([(1, 900_000), (2, 120_000), (3, None)], "session_id long, latest_end_ms long")
    assert [r.start_ms for r in intervals.live_windows(latest).orderBy("start_ms").collect()] == [0, 240_000, 480_000]
    assert [tuple(r) for r in intervals.final_windows(latest.where("session_id = 2")).collect()] == [(2, 0, 300_000)]


def test_insert_new_null_key(spark):
    old = spark.createDataFrame([(1, 7, "a")], "id long, session_id long, description string")
    new = spark.createDataFrame([(2, 7, "a"), (3, 7, "b"), (4, 7, "b"), (5, None, "a"), (6, None, "a")], old.schema)
    assert sorted(r.id for r in state.insert_new(old, new).collect()) == [3, 5, 6]


def test_queue(spark):
    queue = spark.createDataFrame([(1, "t", "pending", 3), (2, "t", "pending", 0), (3, "u", "running", 3)], "id long, tenant_id string, status string, attempts int")
    claimed = {r.id: (r.status, r.attempts) for r in state.claim_next(queue, "tenant_id", ["id"], 3).collect()}
    assert claimed == {1: ("pending", 3), 2: ("running", 1), 3: ("running", 3)}
    from pyspark.sql import functions as F

    assert {r.status for r in state.finish(queue.where("id = 3"), F.lit("failed")).collect()} == {"failed"}


def test_list_rejects_unknown(spark):
    empty = spark.createDataFrame([], "id long, tenant_id string, status string, created_s long")
    with pytest.raises(ValueError):
        relational.list_reminders(empty, empty, "t", status="nope")
