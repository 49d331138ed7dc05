"""Models' answers, translation in batches, and speakers of clips against known cases and plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.functions import text
from colloquy.operators import clustering, translation, vectors

ITEM = '{"description": "call", "labels": ["a"]}'


@pytest.mark.parametrize(
    "answer, found",
    [
        (ITEM, 1),
        (f'{{"todos": [{ITEM}, {ITEM}]}}', 2),
        (f"[{ITEM}]", 1),
        (f"```json\n{ITEM}\n```", 1),
        (f"<think>x</think>{ITEM}", 1),
        (f"thinking </think> so: {ITEM} done", 1),
        (f"<think>{ITEM}", 0),
        (f"list [{ITEM}] end", 1),
        ('{"title": "no description"}', 0),
        ('{"description": "x", "labels": [1]}', 0),
        ('{"description": "x", "priority": null}', 1),
        ("{" * 50, 0),
        ("", 0),
        (None, 0),
    ],
)
def test_recover_todos(answer, found):
    assert len(text.recover_todos(answer)) == found


ONE = '{"id": "1", "text": "eins"}'


@pytest.mark.parametrize(
    "answer, found",
    [
        (f'{{"translations": [{ONE}]}}', ["eins"]),
        (f'{{"translations": [{{"id": "0", "text": "old"}}]}} {{"translations": [{ONE}]}}]}}]', ["eins"]),
        (f"[{ONE}]", ["eins"]),
        (f"```json\n[{ONE}]", ["eins"]),
        (f'<think>{{"translations": []}}</think>[{ONE}]', ["eins"]),
        ('{"translations": [{"id": 1, "text": "x"}]}', None),
        ('{"translations": []}', []),
        ('{"translations": [{"id": "1", "text": "a } b"}]}', ["a } b"]),
        ("nothing", None),
        (None, None),
    ],
)
def test_recover_translations(answer, found):
    rows = text.recover_translations(answer)
    assert (rows if rows is None else [r["text"] for r in rows]) == found


def test_retries_run_out(spark):
    """Lines that no answer names are asked for again until their retries are used up; others of the session then follow."""
    silent = lambda requests: requests.select("session_id", "language", F.lit("{}").alias("answer"))
    rows = [(1, "de", f"l{k}", k, "words", "pending", 0, None) for k in range(5)]
    lines = spark.createDataFrame(rows, "session_id long, language string, id string, start_ms long, text string, status string, attempts int, translation string")
    for _ in range(3):
        lines = spark.createDataFrame(translation.flush(lines, silent).collect(), lines.schema)
    state = {r.id: (r.status, r.attempts) for r in lines.collect()}
    assert state == {f"l{k}": ("error", 3) for k in range(4)} | {"l4": ("pending", 0)}
    last = {r.id: r.translation for r in translation.flush(lines).collect()}
    assert last["l4"] is None or last["l4"] == "de: words"
    assert translation.flush(lines.limit(0)).count() == 0


def test_cache_keeps_the_latest(spark):
    kind = "language string, text string, translation string, seq long"
    old = spark.createDataFrame([("de", "a", "A", 1), ("de", "b", "B", 2), ("fr", "a", "Z", 3)], kind)
    new = spark.createDataFrame([("de", "a", "A2", 4), ("de", "c", "C", 5)], kind)
    assert sorted(map(tuple, translation.remembered(old, new, 2).collect())) == [("de", "b", "B", 2), ("de", "c", "C", 5), ("fr", "a", "Z", 3)]


def test_merges_like_a_plain_loop():
    rng = np.random.default_rng(5)
    for n, distance in ((0, 0.5), (1, 0.5), (30, 0.4), (60, 0.9), (25, 2.0)):
        v = rng.normal(0, 1, (n, 6))
        groups, centers = [[k] for k in range(n)], [x / np.linalg.norm(x) for x in v]
        while len(groups) > 1:
            apart, a, b = min((1 - float(centers[i] @ centers[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            if apart > distance:
                break
            c = centers[a] * len(groups[a]) + centers[b] * len(groups[b])
            centers[a] = c / np.linalg.norm(c)
            groups[a] += groups.pop(b)
            centers.pop(b)
        label = {k: g for g, members in enumerate(sorted(groups, key=min)) for k in members}
        assert clustering.merge_closest(v, distance) == [label[k] for k in range(n)]


def test_speakers_of_clips(spark):
    """Two clips of the same two voices: one is enrolled, one is made by the first clip and found again by the second; a
    voice that spoke too little stays unnamed; tenants do not share speakers."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v, e: [x + e for x in v]
    rows = []
    for tenant, clip, at in ((1, "k1", 0), (1, "k2", 100_000), (2, "k3", 0)):
        for k, v in enumerate([a, near(a, 0.02), b, near(b, 0.02), c]):
            rows.append((tenant, clip, f"{clip}-{k}", at + k * 5000, at + k * 5000 + 4500, v))
    members = spark.createDataFrame(rows, "tenant_id long, clip_id string, id string, start_ms long, end_ms long, embedding array<float>")
    known = spark.createDataFrame([(1, "ann", False, a), (1, "short", False, [1.0, 0.0])], "tenant_id long, speaker_id string, provisional boolean, embedding array<float>")
    found = clustering.assign_clips(members, known, Settings(cluster_min_segments=2, cluster_min_ms=8_000))
    got = {r.id: (r.speaker_id, r.local_index) for r in found.collect()}
    for clip in ("k1", "k2"):
        assert [got[f"{clip}-{k}"] for k in range(5)] == [("ann", 0), ("ann", 0), ("k1/1", 1), ("k1/1", 1), (None, None)]
    assert [got[f"k3-{k}"] for k in range(5)] == [("k3/0", 0), ("k3/0", 0), ("k3/1", 1), ("k3/1", 1), (None, None)]
    assert clustering.assign_clips(members.limit(0), known).count() == 0
    assert clustering.assign_clips(members, known.limit(0)).count() == len(rows)


def test_candidate_list(spark):
    """Two voices in one scope; the longest segment names a candidate, the later one on a tie; rows without a vector go."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("x", 1, 1, 0, 30_000, a), ("x", 2, 1, 50_000, 80_000, a), ("x", 3, 2, 90_000, 95_000, a), ("x", 4, 2, 100_000, 101_000, b), ("x", 5, 2, 0, 99_000, None)]
    kind = "scope string, id long, session_id long, start_ms long, end_ms long, embedding array<float>"
    found = clustering.candidate_list(spark.createDataFrame(rows, kind), "scope", min_rows=3).collect()
    got = sorted((r.candidate, r.member_ids, r.n_rows, r.total_ms, r.n_sessions, r.eligible) for r in found)
    assert got == [("cand_2", [1, 2, 3], 3, 65_000, 2, True), ("cand_4", [4], 1, 1_000, 1, False)]
    assert clustering.candidate_list(spark.createDataFrame([], kind), "scope").count() == 0


def test_match_centroid_keeps_equal_ids(spark):
    """A query's id may be a speaker's too; ties go to the smaller speaker; other lengths match nothing."""
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "id long, embedding array<double>")
    speakers = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "speaker_id long, centroid array<double>")
    assert sorted(map(tuple, vectors.match_centroid(asked, speakers, 0.5).collect())) == [(1, 1, 1.0), (2, None, 0.0), (3, None, 0.0)]


def test_default_translator_is_read_back(spark):
    rows = spark.createDataFrame([(1, "ja", [(0, "x", "ab"), (1, "y", "seven77"), (2, "z", "fives")])], "session_id long, language string, lines array<struct<start_ms:long,id:string,text:string>>")
    answer = translation.marked(rows).first().answer
    assert [json.loads(json.dumps(r)) for r in text.recover_translations(answer)] == [{"id": "x", "text": "ja: ab"}, {"id": "z", "text": " "}]
