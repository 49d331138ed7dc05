"""Repair of JSON, audio files, levels and their reports, and confirmed candidates against known cases and plain loops."""

import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import repair, text, times
from colloquy.operators import candidates, extraction, levels
from colloquy.sources import audio


@pytest.mark.parametrize(
    "answer, value",
    [
        ('{"a": 1, "b": [1,2', {"a": 1, "b": [1, 2]}),
        ("{'a': 'b', 'c': None, 'd': True}", {"a": "b", "c": None, "d": True}),
        ('{"a": "x" "b": "y"}', {"a": "x", "b": "y"}),
        ('{"a": "b"\n"c": 3\n}', {"a": "b", "c": 3}),
        ('{"a": "say "hi" now", "b": 2,}', {"a": 'say "hi" now', "b": 2}),
        ("{a: hello world, t: 10:30, u: http://x.y}", {"a": "hello world", "t": "10:30", "u": "http://x.y"}),
        ('{"a": "cut off \\', {"a": "cut off "}),
        ('{"a":', {"a": None}),
        ('{"a": "x", "des', {"a": "x"}),
        ('{"a", "b": 1}', {"b": 1}),
        ('{"a": 1]}', {"a": 1}),
        ('{"a": [{"b": 2}', {"a": [{"b": 2}]}),
        ('{"a": [1}', {"a": [1]}),
        ("[1 2 true]", [1, 2, True]),
        ("[1,,2,]", [1, 2]),
        ("{“a”: “c”}", {"a": "c"}),
        ('{// c, d\n"a": /* 1, 2 */ 3 /* e */}', {"a": 3}),
        (r'{"a": "\d é"} rest {', {"a": "d é"}),
        ('Sure: {"a": 1} done', {"a": 1}),
        ("{}", {}),
    ],
)
def test_repaired(answer, value):
    assert json.loads(repair.repaired_text(answer)) == value


@pytest.mark.parametrize("answer", ["totally not json at all", "", None, "}]"])
def test_nothing_to_repair(answer):
    assert repair.repaired_text(answer) is None


def test_depth_is_not_limited():
    assert repair.repaired_text("[" * 50_000) == "[" * 50_000 + "]" * 50_000


WORDS = st.text(st.characters(exclude_categories=["Cs"]), max_size=12)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | WORDS, lambda v: st.lists(v, max_size=4) | st.dictionaries(WORDS, v, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, max_size=4) | st.dictionaries(WORDS, VALUES, max_size=4), st.booleans(), st.integers(0, 30))
def test_valid_json_stays_and_lost_ends_come_back(value, plain, cut):
    whole = json.dumps(value, ensure_ascii=plain)
    assert json.loads(repair.repaired_text(whole)) == value
    assert json.loads(repair.repaired_text(whole.rstrip("]}"))) == value
    assert json.loads(repair.repaired_text(json.dumps(value, indent=1).replace(",\n", "\n"))) == value
    assert json.loads(repair.repaired_text(whole[: max(1, len(whole) - cut)])) is not None


def test_answers_that_spark_reads_never_get_to_python(spark):
    rows = [('{"name": "hello"}',), ('```json\n{"name":"hello"}\n```',), ('```\n{"name":"hello"}\n```',), ("{'name': 'hello'",), ("totally not json at all",), ('{"other": 1}',), ("[1]",), ("",), (None,)]
    found = spark.createDataFrame(rows, "a string").select(repair.broken(F.col("a")).alias("b"), repair.typed(F.col("a"), "name string", ("name",))["name"].alias("n"))
    got = [tuple(r) for r in found.collect()]
    assert [n for _, n in got] == ["hello"] * 4 + [None] * 5
    assert [b is not None for b, _ in got] == [False, False, False, True, True, False, False, True, False]


def drawn(n, seed=5):
    return np.random.default_rng(seed).uniform(-1, 1, n)


@pytest.mark.parametrize("bits, floating", [(8, False), (16, False), (24, False), (32, False), (32, True)])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_wav_round_trip(bits, floating, channels):
    samples = drawn(301 * channels)
    found, ms = audio.decode(audio.encode(samples, 16_000, channels, bits, floating))
    assert np.abs(found - samples.reshape(-1, channels).mean(axis=1)).max() <= 2.0 ** (1 - bits) + 1e-6
    assert ms == 301 / 16


def test_wav_rates():
    tone = np.sin(np.arange(48_000) / 200)
    found, ms = audio.decode(audio.encode(tone, 48_000))
    assert len(found) == 16_000 and ms == 1000 and np.abs(found - tone[::3]).max() < 1e-6
    odd = np.arange(100, dtype=np.float32)
    assert len(audio.linear(odd, 44_100, 16_000)) == 36 and len(audio.linear(odd, 44_100, 16_000, round_up=True)) == 37
    assert np.allclose(audio.linear(odd, 8_000, 16_000)[:5], [0, 0.5, 1, 1.5, 2])
    assert audio.linear(odd, 8_000, 16_000)[-1] == 99 and len(audio.linear(odd[:0], 8_000, 16_000)) == 0


def test_odd_wav_files():
    good = audio.encode(drawn(50), 16_000, 1, 16, False)
    with_list = good[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:]
    wide = good[:16] + struct.pack("<I", 40) + struct.pack("<H", 0xFFFE) + good[22:36] + struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 1) + b"\0" * 14 + good[36:]
    for same in (with_list, wide):
        assert np.array_equal(audio.decode(same)[0], audio.decode(good)[0])
    for bad in (None, b"", b"RIFF", good[:40], good[:12], good.replace(b"data", b"dato"), good[:20] + b"\x07\0" + good[22:], good[:22] + b"\0\0" + good[24:]):
        assert audio.decode(bad) is None
    assert audio.decode(good[:-3]) is None and len(audio.decode(good[:-3], strict=True)[0]) == 48
    assert audio.decode(audio.encode(drawn(50), 8_000), strict=True) is None and audio.decode(audio.encode(drawn(50), 16_000, 2), strict=True) is None
    assert len(audio.decode(audio.encode([]))[0]) == 0


def test_wav_files_of_a_folder(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.wav").write_bytes(audio.encode(drawn(32)))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    (tmp_path / "c.json").write_text("{}")
    rows = audio.read(spark, f"file://{tmp_path}").select("path", audio.decoded(F.col("content")).alias("f")).collect()
    found = {r.path.rsplit("/", 1)[1]: r.f and len(r.f.samples) for r in rows}
    assert found == {"a.wav": 32, "b.wav": None}


def plain_levels(rows, every=66):
    level, sent, out = 0.0, None, []
    for at, seq, rms in sorted(rows):
        if rms is not None:
            level = 0.7 * level + 0.3 * rms
            passed = sent is None or at - sent >= every
            sent = at if passed else sent
            out.append((at, seq, level, passed))
    return out


@pytest.mark.parametrize("block_ms, step", [(5_000, 20), (100, 20), (50, 3), (10_000, 1), (70, 400), (1, 5)])
def test_levels_are_those_of_a_loop(spark, block_ms, step):
    rng = np.random.default_rng(block_ms)
    rows, want = [], set()
    for session in range(3):
        at = np.cumsum(rng.integers(0, 2 * step + 1, 900)) - 500
        at[450:] += 3 * block_ms + 7
        rms = [None if x < 0.05 else float(x) for x in rng.uniform(0, 1, 900)]
        mine = [(int(a), k, r) for k, (a, r) in enumerate(zip(at, rms, strict=True))]
        rows += [(session, *m) for m in mine]
        want |= {(session, a, k, round(v, 9), p) for a, k, v, p in plain_levels(mine)}
    smooth = levels.smoothed(spark.createDataFrame(rows, "session_id int, at_ms long, seq int, rms double").repartition(3), block_ms)
    got = {(r.session_id, r.at_ms, r.seq): round(r.level, 9) for r in smooth.collect()}
    assert got.keys() == {w[:3] for w in want} and all(abs(got[w[:3]] - w[3]) < 2e-9 for w in want)
    sent = {(r.session_id, r.at_ms, r.seq) for r in levels.reported(smooth, block_ms=block_ms).collect()}
    assert sent == {w[:3] for w in want if w[4]}


def test_no_levels(spark):
    none = spark.createDataFrame([(1, 5, 0, None)], "session_id int, at_ms long, seq int, rms double")
    assert levels.reported(levels.smoothed(none)).count() == 0


REQUEST = "id string, tenant_id int, display_name string, color string, member_ids array<long>"
SEGMENT = "id long, start_ms long, end_ms long, speaker_id string, audio_ref string, embedding array<double>"


def confirming(spark):
    segments = [(k, 0, 1000 * k, None, f"a{k}" if k % 2 else None, None if k == 5 else [float(k), 1.0]) for k in range(1, 8)]
    requests = [("r1", 1, " Ann ", "red", [1, 2, 3, 4, 5, 5, 99]), ("r2", 1, "Bob", "blue", [2, 7]), ("r3", 1, "\n ", "red", [6]), ("r4", 1, "Cy", "red", []), ("r5", 2, "Di", "red", None), ("r6", 2, "Ed", "red", [99])]
    return spark.createDataFrame(requests, REQUEST), spark.createDataFrame(segments, SEGMENT)


def test_confirming_changes_all_three_relations_once(spark, tmp_path):
    requests, segments = confirming(spark)
    speakers = spark.createDataFrame([], "id string, tenant_id int, display_name string, color string, kind string, status string, created_s long")
    vectors = spark.createDataFrame([], "id string, speaker_id string, segment_id long, embedding array<double>, duration_ms long, quality double, is_primary boolean")
    reasons = {r.id: r.reason for r in candidates.judged(requests, segments, speakers).collect()}
    assert reasons == {"r1": None, "r2": None, "r3": "no_name", "r4": "no_members", "r5": "no_members", "r6": "no_segments"}

    changes, counts = candidates.written(candidates.change_set(requests, segments, speakers), f"file://{tmp_path}/one")
    assert counts == {"speakers": 2, "vectors": 4, "segments": 6, "files": 4}
    after = candidates.applied(changes, speakers, vectors, segments, 77)
    assert {(r.id, r.display_name, r.created_s) for r in after[0].collect()} == {("spk_r1", "Ann", 77), ("spk_r2", "Bob", 77)}
    # of r1 the longest member has no vector, so that none is primary
    assert {(r.speaker_id, r.segment_id, r.is_primary, r.quality) for r in after[1].collect()} == {("spk_r1", 4, False, 0.75), ("spk_r1", 3, False, 0.75), ("spk_r2", 7, True, 0.75), ("spk_r2", 2, False, 0.75)}
    who = {r.id: (r.speaker_id, r.audio_ref) for r in after[2].collect()}
    assert who == {1: ("spk_r1", None), 2: ("spk_r2", None), 3: ("spk_r1", None), 4: ("spk_r1", None), 5: ("spk_r1", None), 6: (None, None), 7: ("spk_r2", None)}
    assert {r.audio_ref for r in candidates.files_to_go(changes).collect()} == {"a1", "a3", "a5", "a7"}

    again, counts = candidates.written(candidates.change_set(requests, after[2], after[0]), f"file://{tmp_path}/two")
    assert set(counts.values()) == {0} and again.count() == 0
    twice = candidates.applied(changes, *after, 99)
    for one, two in zip(after, twice, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_candidates_by_occurrences(spark):
    rows = spark.createDataFrame([("a", 2, 5), ("b", 3, 1), ("c", 2, 9), ("d", 2, 9)], "candidate string, n_rows int, last_ms int")
    assert [r.candidate for r in candidates.by_occurrences(rows, 3).collect()] == ["b", "c", "d"]
    assert [r.candidate for r in candidates.by_occurrences(rows, 3, 1).collect()] == ["c", "d", "a"]


def test_kinds_of_json(spark):
    texts = ['{"a": 1}', "[]", '"x"', "1", "1.5", "true", "null", "no", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", repair.kind(F.col("t")).alias("kind"))
    assert [r.kind for r in rows.orderBy("k").collect()] == ["object", "array", "string", "number", "number", "boolean", "null", None, None, None]


DUES = [
    ("America/New_York", "2024-03-10T02:30", None),  # never
    ("America/New_York", "2024-11-03T01:30:00", None),  # twice
    ("America/New_York", "2024-3-10 3:00", "2024-03-10 07:00:00"),
    ("America/New_York", "2024-11-03 02:00", "2024-11-03 07:00:00"),
    ("America/New_York", "2024-11-03 00:59", "2024-11-03 04:59:00"),
    ("Australia/Lord_Howe", "2024-04-07T01:45", None),  # half an hour, twice
    ("Australia/Lord_Howe", "2024-10-06T02:15", None),
    ("Australia/Lord_Howe", "2024-10-06T02:30", "2024-10-05 15:30:00"),
    ("UTC", "2024-01-02T3:04", "2024-01-02 03:04:00"),
    ("UTC", "02.01.2024", None),
    ("UTC", "2024-01-02 03:04:05", None),
    ("UTC", None, None),
]


@pytest.mark.parametrize("zone", sorted({d[0] for d in DUES}))
def test_due_times_that_are_clear(spark, zone):
    mine = [(k, t, w) for k, (z, t, w) in enumerate(DUES) if z == zone]
    rows = spark.createDataFrame([m[:2] for m in mine], "k int, t string").select("k", times.asked_due(F.col("t"), zone).alias("due"))
    assert {r.k: r.due for r in rows.collect()} == {k: w for k, _, w in mine}


def test_names_are_compared_by_ascii_case(spark):
    rows = spark.createDataFrame([("ABZÄß",), (None,)], "t string").select(text.ascii_lower(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["abzÄß", None]
    lines = spark.createDataFrame([(1, 0, 5, "l1", "s1", "x", "ÄNNE"), (1, 0, 6, "l2", "s2", "y", "Bob")], "session_id int, window_start int, start_ms int, id string, speaker_id string, text string, speaker_name string")
    items = spark.createDataFrame([("i1", 1, 0, "none of it", "änne"), ("i2", 1, 0, "none of it", "BOB"), ("i3", 1, 0, "none of it", "Ännе"), ("i4", 1, 0, "none of it", "UNKNOWN")], "item_id string, session_id int, window_start int, evidence_quote string, speaker_name string")
    assert {r.item_id: r.speaker_id for r in extraction.speakers_of_items(items, lines).collect()} == {"i1": None, "i2": "s2", "i3": None, "i4": None}
