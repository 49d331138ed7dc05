"""Clip manifests as JSON lines, the segments that they list, and files past their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "array<struct<id: long, start_ms: long, end_ms: long, file: string>>"
SCHEMA = f"clip_id string, session_id long, started_at_ms long, ended_at_ms long, segments {SEGMENTS}"
DAY_S = 86_400


def manifests(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each clip (id, session_id, started_at_ms, ended_at_ms) with its segments (clip_id, id, start_ms,
    end_ms) by start. A clip is closed after minutes, so its list is short; a clip without segments has an empty one."""
    entry = F.struct("start_ms", "id", "end_ms")
    lists = segments.groupBy("clip_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    listed = F.transform("entries", lambda e: F.struct(e["id"].cast("long").alias("id"), e["start_ms"].alias("start_ms"), e["end_ms"].alias("end_ms"), F.concat(e["id"].cast("string"), F.lit(".wav")).alias("file")))
    rows = clips.select(F.col("id").alias("clip_id"), "session_id", "started_at_ms", "ended_at_ms").join(lists, "clip_id", "left")
    return rows.select("clip_id", "session_id", "started_at_ms", "ended_at_ms", F.coalesce(listed, F.array().cast(SEGMENTS)).alias("segments"))


def write(rows: DataFrame, path: str) -> None:
    """Manifests as JSON lines, one folder for each session."""
    rows.withColumn("session", F.col("session_id")).write.mode("overwrite").partitionBy("session").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the schema given, so that nothing is read twice; missing lists are null."""
    return spark.read.schema(SCHEMA).json(path).drop("session")


def listed(rows: DataFrame) -> DataFrame:
    """The segments that manifests list, each with its clip and session."""
    return rows.select("clip_id", "session_id", F.explode("segments").alias("s")).select("clip_id", "session_id", "s.*")


def inside_folder(name: Column) -> Column:
    """Whether a file name stays in its own folder: not empty or hidden, no separators, drive letters or parents."""
    return F.coalesce(~(name.rlike(r"^(\.|$)") | name.rlike(r"[/\\:]") | name.contains("..")), F.lit(False))


def audio_paths(rows: DataFrame, wanted: DataFrame, folder: Column) -> DataFrame:
    """Of the wanted segments (clip_id, id) those that a manifest lists, with the path of their audio; names that
    would leave the folder give null."""
    found = listed(rows).withColumn("folder", folder).join(wanted.select("clip_id", "id").distinct(), ["clip_id", "id"])
    return found.select("clip_id", "id", F.when(inside_folder(F.col("file")), F.concat_ws("/", "folder", "file")).alias("path"))


def processed(rows: DataFrame) -> DataFrame:
    """State of each clip once its manifest is read: empty without segments, else processed."""
    n = F.coalesce(F.size("segments"), F.lit(0))
    return rows.select("clip_id", F.when(n <= 0, "empty").otherwise("processed").alias("status"), F.greatest(n, F.lit(0)).alias("n_segments"))


def kept_speech(segments: DataFrame, mutes: DataFrame) -> DataFrame:
    """Segments that do not start while the session is muted. mutes: session_id, from_ms, until_ms (null: still muted),
    a session's spans apart from each other."""
    here, there = F.col("s.start_ms"), F.coalesce("m.until_ms", F.lit(2**62))
    muted = (F.col("s.session_id") == F.col("m.session_id")) & (here >= F.col("m.from_ms")) & (here < there)
    return segments.alias("s").join(mutes.alias("m"), muted, "left_anti")


def stale(files: DataFrame, now_s: int, days: int, kind: str = "") -> DataFrame:
    """Files (path, modified_s) older than so many days whose name ends with kind; unknown times are kept."""
    old = F.col("modified_s") < now_s - days * DAY_S
    return files.where(old & F.col("path").endswith(kind))
