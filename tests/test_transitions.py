"""Rounds over windows: claims, outcomes, and commits that are made again."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import extraction, transitions
from colloquy.plans.store_queries import SHORT
from colloquy.plans.transition_queries import inputs, unsteady

TABLES = "/root/testdata/sf0.001"
NOW = 1_706_000_000


def shape(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def window(i, start, status="pending", attempts=0, session=1, created=0):
    return (i, session, start, start + 60_000, status, attempts, created, None, None)


QUEUE = "id string, session_id long, start_ms long, end_ms long, status string, attempts int, created_s long, last_error string, finished_s long"


def test_claim_takes_the_oldest(spark):
    rows = [window("a", 5, created=2), window("b", 9, created=1), window("c", 1, created=1), window("d", 0, "running"), window("e", 0, "failed"), window("f", 0, session=2, created=9)]
    queue = spark.createDataFrame(rows, QUEUE)
    taken = lambda **k: {r.id for r in transitions.claim(queue, **k).where("claimed").collect()}
    assert taken(most=2) == {"c", "b"} and taken(by="session_id", most=1) == {"c", "f"} and taken() == {"a", "b", "c", "f"}
    after = {r.id: (r.status, r.attempts) for r in transitions.claim(queue, most=1).collect()}
    assert after == {"a": ("pending", 0), "b": ("pending", 0), "c": ("running", 1), "d": ("running", 0), "e": ("failed", 0), "f": ("pending", 0)}


def settled(spark, rows, said, answers):
    queue = spark.createDataFrame(rows, QUEUE)
    lines = spark.createDataFrame([(1, f"l{k}", 1000 * k, 1000 * k + 500, t, "s1", "Ann") for k, t in enumerate(said)], "session_id long, id string, start_ms long, end_ms long, text string, speaker_id string, speaker_name string")
    starts = spark.createDataFrame([(1, 1_000_000)], "session_id long, started_ms long")
    labels = spark.createDataFrame([("L", "Work")], "id string, name string")
    stored = spark.createDataFrame([(1, "known")], "session_id long, description string")
    claimed = transitions.claim(queue)
    heard = extraction.heard_lines(transitions.ready(claimed, starts), lines)
    schema = "item_id string, session_id long, window_start long, title string, description string, priority string, due_time string, labels array<string>, confidence string, evidence_quote string, speaker_name string, error string"
    found = spark.createDataFrame(answers, schema).join(heard.select("session_id", "window_start").distinct(), ["session_id", "window_start"], "left_semi")
    after, made = transitions.settle(claimed, heard, found, starts, labels, stored, NOW)
    return {r.id: (r.status, r.attempts, r.last_error, r.finished_s) for r in after.collect()}, {r.id: (r.description, r.speaker_id, r.source_ms, list(r.label_ids)) for r in made.collect()}


def item(i, start, description="call the bank", confidence="high", quote="BANK", error=None):
    return (i, 1, start, "t", description, "high", None, ["work"], confidence, quote, "Ann", error)


LONG = "please call the bank before noon tomorrow, it is about the old account"


@pytest.mark.parametrize(
    "row, said, answers, want, n",
    [
        (window("w", 0), [LONG], [item("i", 0)], ("succeeded", 1, None, NOW), 1),
        (window("w", 0), [LONG], [item("i", 0, "known")], ("succeeded", 1, None, NOW), 0),  # it is there already
        (window("w", 0), [LONG], [item("i", 0, confidence="low")], ("empty", 1, None, NOW), 0),
        (window("w", 0), [LONG], [], ("empty", 1, None, NOW), 0),
        (window("w", 0), ["short"], [item("i", 0)], ("empty", 1, None, NOW), 0),
        (window("w", 0), [LONG], [item("i", 0), item("j", 0, error="busy")], ("pending", 1, "llm error: busy", None), 0),
        (window("w", 0), [LONG], [item("j", 0, error="llm disabled")], ("pending", 1, "llm disabled", None), 0),
        (window("w", 0, attempts=2), [LONG], [item("i", 0)], ("succeeded", 3, None, NOW), 1),
        (window("w", 0, attempts=3), [LONG], [item("i", 0)], ("failed", 4, "max attempts exceeded", NOW), 0),
        (window("w", 0, session=2), [LONG], [], ("failed", 1, "session lookup", NOW), 0),
        (window("w", 0, "running", 1), [LONG], [item("i", 0)], ("running", 1, None, None), 0),
        (window("w", 0, "failed", 9), [LONG], [item("i", 0)], ("failed", 9, None, None), 0),
    ],
)
def test_outcomes(spark, row, said, answers, want, n):
    after, made = settled(spark, [row], said, answers)
    assert after == {"w": want} and len(made) == n
    if n:
        assert made["i"] == ("call the bank", "s1", 1_000_000, ["L"])


def test_commits_repeat_and_replay_changes_nothing(spark, tmp_path):
    queue, lines, starts, labels = inputs(spark, TABLES)
    stored = spark.createDataFrame([], "session_id long, description string, id string, status string")
    asked = []

    def extract(heard):
        asked.append(1)
        return unsteady(heard)

    ledger = transitions.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.begin(queue.where("session_id % 2 = 0"), stored)
    arriving = queue.where("session_id % 2 = 1")

    def batch(k):
        part = arriving.where(F.col("session_id") % 3 == k) if k < 3 else arriving.limit(0)
        ledger.commit(k, part, lines, starts, labels, extract, NOW + k, settings=SHORT, most=40)

    for k in range(5):
        batch(k)
    before = {(name, k): shape(ledger.version(name, k)) for name in ("queue", "reminders", "answers") for k in range(5)}
    assert len(asked) == 5 and ledger.version("queue", 4).count() == queue.count()
    ledger.begin(queue, stored)
    for k in (4, 2):
        batch(k)
    assert len(asked) == 5
    assert before == {(name, k): shape(ledger.version(name, k)) for name in ("queue", "reminders", "answers") for k in range(5)}
    states = {r.status for r in ledger.version("queue", 4).select("status").distinct().collect()}
    assert {"succeeded", "empty", "failed"} <= states
    ids = [r.id for r in ledger.version("reminders", 4).collect()]
    assert ids and len(ids) == len(set(ids))


def test_a_commit_that_broke_off_is_finished(spark, tmp_path):
    """Claims and answers are written, then the driver dies: the next attempt does not ask again."""
    queue, lines, starts, labels = inputs(spark, TABLES)
    stored = spark.createDataFrame([], "session_id long, description string, id string, status string")
    whole, broken = (transitions.Ledger(spark, f"file://{tmp_path}/{name}") for name in ("whole", "broken"))
    for ledger in (whole, broken):
        ledger.begin(queue, stored)
    whole.commit(0, queue.limit(0), lines, starts, labels, unsteady, NOW, settings=SHORT)
    once, asked = broken._once, []

    def dies(make, path):
        if "/reminders/" in path:
            raise RuntimeError("lost")
        return once(make, path)

    def extract(heard):
        asked.append(1)
        return unsteady(heard)

    broken._once = dies
    with pytest.raises(RuntimeError):
        broken.commit(0, queue.limit(0), lines, starts, labels, extract, NOW, settings=SHORT)
    broken._once = once
    broken.commit(0, queue.limit(0), lines, starts, labels, extract, NOW, settings=SHORT)
    assert len(asked) == 1
    for name in ("queue", "reminders"):
        assert shape(broken.version(name, 0)) == shape(whole.version(name, 0))
