"""Clips and their manifests: plain loop, batch, and a stream with timers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_voices import rocks  # noqa: F401

from colloquy.config import Settings
from colloquy.sources import manifests
from colloquy.streaming import clips

SCHEMA = "session_id long, id long, kind string, start_ms long, end_ms long, archived boolean"
SHORT = Settings(clip_target_ms=30_000, clip_max_ms=40_000, silence_close_ms=1_500)
T0 = 1_706_000_000_000


def drawn(seed=1, n=400):
    rng, at, out = np.random.default_rng(seed), {}, []
    for k in range(n):
        session = int(rng.integers(0, 4))
        begin = at.get(session, T0) + int(rng.choice([100, 1_000, 1_499, 1_500, 6_000, 90_000], p=[0.3, 0.3, 0.1, 0.1, 0.15, 0.05]))
        kind = "mute" if rng.random() < 0.05 else "speech"
        length = int(rng.integers(200, 9_000)) if kind == "speech" else 0
        at[session] = begin + length
        out.append((session, k, kind, begin, begin + length, [True, None, True, False][int(rng.integers(0, 4))] if kind == "speech" else True))
    return out


def looped(rows, until, s):
    """Clips by a clock that ticks through each session: at every millisecond that matters."""
    out = []
    for session in sorted({r[0] for r in rows}):
        began = spoken = None
        held = []

        def shut(at):
            out.append((session, began, held[-1][2], at, [h[0] for h in held]))

        todo = sorted(r for r in rows if r[0] == session and r[3] <= until)
        for _, i, kind, start, end, archived in sorted(todo, key=lambda r: (r[3], r[1])) + [(session, None, "end", until, until, True)]:
            if began is not None:
                ticks = sorted({began + s.clip_max_ms, began + s.clip_target_ms, spoken + s.silence_close_ms})
                for now in ticks:
                    if now <= start and (now - began >= s.clip_max_ms or (now - began >= s.clip_target_ms and now - spoken >= s.silence_close_ms)):
                        shut(now)
                        began = None
                        break
            if began is None:
                held = []
            if kind == "speech" and archived is not False:
                began = start if began is None else began
                spoken = end
                held.append((i, start, end))
                if end - began >= s.clip_max_ms:
                    shut(end)
                    began = None
            if kind == "mute" and began is not None:
                shut(start)
                began = None
    return sorted(out)


def shape(df):
    return sorted((r.session_id, r.started_at_ms, r.ended_at_ms, r.closed_at_ms, [x.id for x in r.segments]) for r in df.collect())


def test_batch_is_the_plain_loop(spark):
    rows = drawn()
    events = spark.createDataFrame(rows, SCHEMA)
    until = max(r[4] for r in rows) + 100_000
    made = clips.clip_manifests(events, until, SHORT)
    want = looped(rows, until, SHORT)
    assert shape(made) == want and len(want) > 20
    first = made.orderBy("session_id", "started_at_ms").first()
    assert first.clip_id == f"{first.session_id}-{first.started_at_ms}" and [x.file for x in first.segments][:2] == ["seg_0001.wav", "seg_0002.wav"]
    middle = T0 + 300_000
    assert shape(clips.clip_manifests(events, middle, SHORT)) == looped(rows, middle, SHORT)
    ids = [i for w in want for i in w[-1]]
    assert sorted(ids) == [r[1] for r in rows if r[2] == "speech" and r[5] is not False]  # each archived segment in one clip


@pytest.mark.parametrize("kind, archived, closed", [("mute", False, True), ("speech", False, False), ("speech", True, False)])
def test_privacy(spark, kind, archived, closed):
    rows = [(1, 1, "speech", 0, 5_000, True), (1, 2, kind, 6_000, 7_000, archived)]
    made = clips.clip_manifests(spark.createDataFrame(rows, SCHEMA), 8_000, SHORT).collect()
    assert len(made) == closed and all([x.id for x in r.segments] == [1] for r in made)


def test_stream_gives_the_batch_and_keeps_no_closed_clip(rocks, tmp_path):  # noqa: F811
    spark, rows = rocks, drawn(7, 200)
    last = max(r[4] for r in rows)
    rows.append((99, 9_000, "mute", last + 400_000, last + 400_000, True))  # time goes on in another session
    rows.append((98, 9_001, "speech", last + 500_000, last + 501_000, True))
    rows.append((98, 9_002, "speech", last + 502_000, last + 503_000, True))
    rows.sort(key=lambda r: r[3])
    events = spark.createDataFrame(rows, SCHEMA)
    bounds = [rows[k][3] for k in range(0, len(rows), 40)] + [2**62]
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        events.where((F.col("start_ms") >= lo) & (F.col("start_ms") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = clips.stream_clip_manifests(source, "1 second", SHORT).writeStream.format("memory").queryName("recorded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    want = looped(rows, last + 500_000, SHORT)
    assert shape(spark.table("recorded")) == want and len(want) > 10
    left = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "ck"))
    assert [r.key.session_id for r in left.collect()] == [98]  # the one clip that is still open


def test_manifests_round_trip(spark, tmp_path):
    made = clips.clip_manifests(spark.createDataFrame(drawn(3, 80), SCHEMA), 2**60, SHORT).drop("closed_at_ms")
    manifests.write(made, str(tmp_path / "out"))
    again = manifests.read(spark, str(tmp_path / "out"))
    by = lambda df: sorted(map(str, df.select("clip_id", "session_id", "started_at_ms", "ended_at_ms", "segments").collect()))
    assert by(again) == by(made)
    assert manifests.listed(again).count() == sum(1 for r in drawn(3, 80) if r[2] == "speech" and r[5] is not False)
