"""Enrolment and attribution of segments: batch, stream and plain loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.functions.signal import GOOD
from colloquy.operators import vectors
from colloquy.streaming import voices as V

SCHEMA = "tenant_id long, seq long, kind string, id string, speaker_id string, target int, session_id long, start_ms long, end_ms long, duration_ms long, quality double, level double, embedding array<float>"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def drawn(seed=4, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows, at = [], {}
    for seq in range(n):
        tenant = int(rng.integers(0, 3))
        kind = str(rng.choice(["segment"] * 9 + ["start", "cancel", "level"]))
        session = tenant * 10 + int(rng.integers(0, 2))
        begin = at.get(session, 0) + int(rng.integers(100, 9000))
        length = int(rng.choice([800, 1500, 2999, 3000, 5000, 30000, 30001]))
        vector = None
        if kind == "segment":
            at[session] = begin + length
            if rng.random() > 0.1:
                vector = [float(np.float32(x)) for x in centres[rng.integers(0, 6)] + rng.normal(size=12) * rng.choice([0.2, 1.0, 1.6])]
        speaker, target = (f"new{rng.integers(0, 4)}", int(rng.integers(1, 5))) if kind == "start" else (None, None)
        rows.append((tenant, seq, kind, f"e{seq:04}", speaker, target, session, begin, begin + length, length, float(rng.choice([0.2, 0.6, 0.9])), 0.5 if kind == "level" else None, vector))
    held = [(t, k * 3 + t, f"s{k % 6}", [float(np.float32(x)) for x in centres[k % 6] + rng.normal(size=12) * 0.3]) for t in range(2) for k in range(150)]
    return rows, held


def enrolments(rows):
    """(tenant, seq, change, captured, version, reason, removed) by a plain loop."""
    out, now = [], {}
    for r in rows:
        tenant, seq, kind, name, speaker, target, length, quality = *r[:6], r[9], r[10]
        s = now.get(tenant)
        if kind == "start":
            if s:
                out.append((tenant, seq, "refused", s["n"], s["version"], "enrollment_already_active", []))
            else:
                now[tenant] = {"speaker": speaker, "target": target, "n": 0, "version": 1, "ids": []}
                out.append((tenant, seq, "started", 0, 1, None, []))
        elif s and kind == "cancel":
            out.append((tenant, seq, "cancelled", s["n"], s["version"] + 1, None, s["ids"]))
            del now[tenant]
        elif s and kind == "segment":
            s["version"] += 1
            reason = "too_short" if length < 3000 else "too_long" if length > 30000 else "low_quality" if quality < GOOD else None
            if reason is None:
                s["n"] += 1
                if s["n"] >= s["target"]:
                    out.append((tenant, seq, "completed", s["n"], s["version"] + 1, None, []))
                    del now[tenant]
                    continue
                s["ids"].append(name)
            out.append((tenant, seq, "rejected" if reason else "captured", s["n"], s["version"], reason, []))
    return sorted(((*o[:-1], list(o[-1])) for o in out), key=lambda r: r[:2])


def trace(df):
    return sorted(((r.tenant_id, r.seq, r.change, r.captured, r.version, r.reason, list(r.removed)) for r in df.collect()), key=lambda r: r[:2])


def streamed(spark, df, parts, tmp_path, name, made):
    numbered = df.withColumn("__part", F.ntile(parts).over(Window.orderBy("seq"))).persist()
    for k in range(parts):
        numbered.where(F.col("__part") == k + 1).drop("__part").coalesce(1).write.parquet(str(tmp_path / f"{name}/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}/*"))
    run = made(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    return spark.table(name)


def test_enrolment_is_the_plain_loop_in_batch_and_stream(rocks, tmp_path):
    rows, _ = drawn()
    events = rocks.createDataFrame(rows, SCHEMA)
    want = enrolments(rows)
    assert {w[2] for w in want} == {"started", "refused", "captured", "rejected", "completed", "cancelled"}
    assert any(w[-1] for w in want)
    changes = V.enrolment_changes(events)
    assert trace(changes) == want
    assert trace(streamed(rocks, events, 6, tmp_path, "enrolling", V.stream_enrolment_changes)) == want
    held = rocks.createDataFrame([("old", "new1", True)], "id string, speaker_id string, is_primary boolean")
    left = {r.id for r in V.enrolled_vectors(held, changes).collect()}
    captured, back = ({rows[w[1]][3] for w in want if w[2] in ("captured", "completed")}, {i for w in want for i in w[-1]})
    assert left == {"old"} | captured - back and back


def test_first_sample_is_primary_and_cancel_keeps_earlier_ones(spark):
    segment = lambda seq, name: (1, seq, "segment", name, None, None, 1, 0, 5000, 5000, 0.9, None, None)
    command = lambda seq, kind: (1, seq, kind, None, "x" if kind == "start" else None, 2, 1, 0, 0, 0, 0.0, None, None)
    events = [command(0, "start"), segment(1, "a"), segment(2, "b"), command(3, "cancel"), command(4, "start"), segment(5, "c"), command(6, "cancel"), segment(7, "d")]
    changes = V.enrolment_changes(spark.createDataFrame(events, SCHEMA))
    none = spark.createDataFrame([], "id string, speaker_id string, is_primary boolean")
    assert sorted(map(tuple, V.enrolled_vectors(none, changes).collect())) == [("a", "x", True), ("b", "x", False)]
    assert [(r.seq, r.change) for r in changes.orderBy("seq").collect()] == [(0, "started"), (1, "captured"), (2, "completed"), (4, "started"), (5, "captured"), (6, "cancelled")]


def attributions(rows, held, taken, settings):
    """(id, speaker, confidence, carried, score, retained) by a plain loop over all voices."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    state, out = {}, {}
    for r in sorted((r for r in rows if r[2] == "segment"), key=lambda r: (r[8], r[3])):
        tenant, name, session, start, end, quality, vector = r[0], r[3], r[6], r[7], r[8], r[10], r[12]
        if name in taken:
            out[name] = (taken[name], "confirmed", False, None, False)
            continue
        if vector is None:
            out[name] = (None, None, False, None, False)
            continue
        sim, who = -2.0, None
        if end - start >= settings.min_duration_ms:
            for t, _, speaker, v in held:
                if t == tenant and float(unit(v) @ unit(vector)) > sim:
                    sim, who = float(unit(v) @ unit(vector)), speaker
        level = "confirmed" if sim >= settings.confirm else "tentative" if sim >= settings.tentative else "unknown"
        speaker, at, rival = state.get(session, (None, None, None))
        fresh = at is not None and 0 <= end - at <= settings.continuity_ms
        if level == "unknown":
            made = (speaker, "tentative", True) if fresh else (None, None, False)
        elif level == "tentative" and fresh and speaker != who and rival != who:
            state[session], made = (speaker, at, who), (speaker, "tentative", True)
        else:
            state[session], made = (who, end, None), (who, level, False)
        out[name] = (*made, None if made[2] or level == "unknown" else round(sim, 6), made[0] is None and quality >= GOOD)
    return out


def given(df):
    rows = df.collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.speaker_id, r.confidence, r.carried_over, None if r.score is None else round(r.score, 6), r.retained) for r in rows}


def test_attribution_is_the_plain_loop_in_batch_and_stream(rocks, tmp_path):
    rows, held = drawn(9, 300)
    settings = Settings(confirm=0.8, tentative=0.5)
    events = rocks.createDataFrame(rows, SCHEMA)
    pool = rocks.createDataFrame(held, "tenant_id long, id long, speaker_id string, embedding array<float>")
    blocks = vectors.voice_blocks(pool, 16)
    assert blocks.where("tenant_id = 0").count() > 5
    want = attributions(rows, held, {}, settings)
    assert {w[1] for w in want.values()} == {"confirmed", "tentative", None} and any(w[2] for w in want.values())
    assert given(V.attribute_segments(events.where("kind = 'segment'"), pool, settings)) == want
    segments = events.where("kind = 'segment'")
    assert given(streamed(rocks, segments, 4, tmp_path, "heard_segments", lambda s: V.stream_attribution(s, blocks, settings))) == want
    taken = {rows[w[1]][3]: None for w in enrolments(rows) if w[2] in ("captured", "completed")}
    speaker = {}
    for r in rows:  # whose enrolment is on
        if r[2] == "start" and (r[0], r[1], "started") in {w[:3] for w in enrolments(rows)}:
            speaker[r[0]] = r[4]
        if r[3] in taken:
            taken[r[3]] = speaker[r[0]]
    want = attributions(rows, held, taken, settings)
    assert taken and given(V.attribute_while_enrolling(events, pool, settings)) == want
    assert given(streamed(rocks, events, 4, tmp_path, "while_enrolling", lambda s: V.stream_while_enrolling(s, blocks, settings))) == want


def test_min_duration_is_read(spark):
    rows, held = drawn(2, 60)
    pool = spark.createDataFrame(held, "tenant_id long, id long, speaker_id string, embedding array<float>")
    segments = spark.createDataFrame(rows, SCHEMA).where("kind = 'segment'")
    for least in (0, 3000, 10**9):
        found = V.segment_evidence(segments, pool, Settings(confirm=-1.0, tentative=-1.0, min_duration_ms=least)).where("evidence = 'confirmed'").count()
        assert found == segments.where(f"end_ms - start_ms >= {least} AND embedding IS NOT NULL AND tenant_id < 2").count()


def written(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    empty = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, gateway.new_array(jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def many(spark, tmp_path):
    """Events and voices whose vectors take 64 numbers that no compression shortens."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.normal(size=(n, 64)).tolist()
    events = [(i % 4, i, "start" if i % 50 == 0 else "segment", f"e{i:05}", "new" if i % 50 == 0 else None, 3, i % 40, i * 1000, i * 1000 + 4000, 4000, 0.9, None, v) for i, v in enumerate(draw(4000))]
    held = [(i % 4, i, f"s{i % 9}", v) for i, v in enumerate(draw(400))]
    spark.createDataFrame(events, SCHEMA.replace("embedding array<float>", "embedding array<double>")).write.parquet(str(tmp_path / "events"))
    spark.createDataFrame(held, "tenant_id long, id long, speaker_id string, embedding array<double>").write.parquet(str(tmp_path / "held"))
    return spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "held"))


@pytest.fixture
def large(spark):
    """Joins as for tables too large to be broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_vectors_of_segments_are_not_shuffled(large, monkeypatch, tmp_path):
    for name in ("POOL_BLOCK", "PACKED"):  # blocks of 20 vectors
        monkeypatch.setattr(vectors, name, 20 if name == "POOL_BLOCK" else 20 * 64)
    events, held = many(large, tmp_path)
    before = written(large)
    assert V.segment_evidence(events.where("kind = 'segment'"), held, Settings(tentative=-1.0)).where("sim IS NOT NULL").count() == 3920
    assert 0 < written(large) - before < 4000 * 64 * 8 / 2


def test_vectors_of_events_are_not_shuffled(large, monkeypatch, tmp_path):
    for name in ("POOL_BLOCK", "PACKED"):  # blocks of 20 vectors
        monkeypatch.setattr(vectors, name, 20 if name == "POOL_BLOCK" else 20 * 64)
    events, held = many(large, tmp_path)
    before = written(large)
    found = V.attribute_while_enrolling(events, held, Settings(tentative=-1.0)).groupBy("confidence").count().collect()
    assert sum(r["count"] for r in found) == 3920 and len(found) == 2
    assert 0 < written(large) - before < 4000 * 64 * 8 / 2


def test_neighbours_of_a_tenant(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3 if k % 10 else None, k, f"s{k}", [float(x) for x in rng.normal(size=5)]) for k in range(90)]
    pool = spark.createDataFrame(rows, "tenant_id long, id long, speaker_id string, embedding array<double>")
    near = vectors.nearest(pool, pool, 2, by="tenant_id").collect()
    unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    want = {}
    for t, k, *_ in rows:
        if t is not None:
            others = sorted((-round(float(unit[k] @ unit[o]), 9), o) for u, o, *_ in rows if u == t and o != k)
            want[k] = [o for _, o in others[:2]]
    found = {k: [r.id for r in sorted(near, key=lambda r: r.place) if r.query == k] for k in want}
    assert found == want and len(near) == 2 * len(want)
