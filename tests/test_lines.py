"""Lines and speakers that come in either order, and clip manifests on disk."""

from pyspark.sql import functions as F

from colloquy.plans.line_queries import line_events
from colloquy.sources import manifests
from colloquy.streaming import lines

SCHEMA = "session_id long, seq long, at_ms long, kind string, id string, text string, start_ms long, end_ms long, speaker_id string"
TABLES = "/root/testdata/sf0.001"


def final(seq, at, name, start, end, speaker=None, text="good morning", kind="final"):
    return (1, seq, at, kind, name, text, start, end, speaker)


def span(seq, at, start, end, speaker):
    return (1, seq, at, "speaker", None, None, start, end, speaker)


def outcome(spark, events):
    rows = lines.lines(lines.line_changes(spark.createDataFrame(events, SCHEMA))).collect()
    return {r.id: (r.speaker_id, r.resolved) for r in rows}


def test_either_order(spark):
    assert outcome(spark, [final(1, 0, "a", 0, 1000), span(2, 10, 0, 1000, "x")]) == {"a": ("x", True)}
    assert outcome(spark, [span(1, 0, 0, 1000, "x"), final(2, 10, "a", 0, 1000)]) == {"a": ("x", True)}
    assert outcome(spark, [span(1, 0, 0, 1000, "x"), final(2, 30_000, "a", 0, 1000), final(3, 30_000, "b", 0, 1000)]) == {"a": ("x", True), "b": (None, False)}


def test_midpoint_wait_and_known_speakers(spark):
    assert outcome(spark, [span(1, 0, 0, 499, "x"), final(2, 1, "a", 0, 1000)]) == {"a": (None, False)}
    assert outcome(spark, [span(1, 0, 0, 500, "x"), final(2, 1, "a", 0, 1000)]) == {"a": ("x", True)}
    assert outcome(spark, [span(1, 0, 0, 1000, "x"), final(2, 30_001, "a", 0, 1000)]) == {"a": (None, False)}
    assert outcome(spark, [final(1, 0, "a", 0, 1000, "y"), span(2, 1, 0, 1000, "x"), final(3, 2, "b", 0, 900)]) == {"a": ("y", True), "b": ("x", True)}
    assert outcome(spark, [final(1, 0, "a", 0, 1000), span(2, 1, 0, 1000, None), span(3, 2, 0, 1000, "x")]) == {"a": (None, True)}


def test_oldest_waiting_goes(spark):
    spans = [span(i, i, 10 * i, 10 * i, f"s{i}") for i in range(65)]
    assert outcome(spark, [*spans, final(70, 70, "a", 0, 0), final(71, 71, "b", 10, 10)]) == {"a": (None, False), "b": ("s1", True)}


def test_lines_again_noise_and_partials(spark):
    events = [final(1, 0, "p", 0, 9, text="goo", kind="partial"), final(2, 1, "n", 0, 9, text="."), final(3, 2, "a", 0, 10), final(4, 3, "a", 100, 110, text="good day"), span(5, 4, 100, 110, "x"), final(6, 5, "e", 0, 9, text=" ")]
    made = lines.line_changes(spark.createDataFrame(events, SCHEMA)).orderBy("seq").collect()
    assert [(r.seq, r.change, r.id) for r in made] == [(1, "partial", "p"), (2, "cleared", None), (3, "line", "a"), (4, "line", "a"), (5, "named", "a")]
    assert outcome(spark, events) == {"a": ("x", True)}


def test_stream_equals_batch(spark, tmp_path):
    events = line_events(spark, TABLES).where("session_id < 20")
    bound = 100_000 * 4096
    for k, part in enumerate((events.where(F.col("seq") < bound), events.where(F.col("seq") >= bound))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    events = spark.read.parquet(str(tmp_path / "in/0"), str(tmp_path / "in/1"))
    wanted = sorted(map(str, lines.line_changes(events).collect()))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = lines.stream_line_changes(source).writeStream.format("memory").queryName("spoken").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = sorted(map(str, spark.table("spoken").collect()))
    assert found == wanted and any("named" in r for r in found)


def test_manifests_on_disk(spark, tmp_path):
    clips = spark.createDataFrame([("c1", 1, 0, 900), ("c2", 2, 50, 60)], "id string, session_id long, started_at_ms long, ended_at_ms long")
    segments = spark.createDataFrame([("c1", 8, 400, 500), ("c1", 7, 400, 450), ("c1", 9, 10, 20)], "clip_id string, id long, start_ms long, end_ms long")
    rows = manifests.manifests(clips, segments)
    manifests.write(rows, str(tmp_path / "m"))
    again = manifests.read(spark, str(tmp_path / "m"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert [r.id for r in again.where("clip_id = 'c1'").first().segments] == [9, 7, 8]
    assert {(r.clip_id, r.status) for r in manifests.processed(again).collect()} == {("c1", "processed"), ("c2", "empty")}
    names = spark.createDataFrame([(n,) for n in ("a.wav", "", ".a", "a/b", "a\\b", "c:a", "a..b", None)], "n string")
    assert [r.ok for r in names.select(manifests.inside_folder(F.col("n")).alias("ok")).collect()] == [True] + [False] * 7
