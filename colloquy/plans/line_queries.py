"""The registered queries over transcript lines as they arrive, and clip manifests, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources import manifests as M
from colloquy.sources import relations as R
from colloquy.sources.relations import with_sql
from colloquy.streaming import lines

NOW_S = 1_706_000_000


def line_events(spark: SparkSession, d: str) -> DataFrame:
    """Lines as partials and then finals, and the speakers of segments, some before and some after their lines."""
    spoken = R.transcripts(spark, d)
    said = spoken.select("session_id", (F.col("end_ms") + 2_000).alias("at_ms"), F.when(F.col("is_final"), "final").otherwise("partial").alias("kind"), "id", "text", "start_ms", "end_ms", F.lit(None).cast("string").alias("speaker_id"))
    delay = F.pmod(F.xxhash64("id"), F.lit(20_000)) - 5_000
    heard = R.segments(spark, d).select("session_id", (F.col("start_ms") + 10_000 + delay).alias("at_ms"), F.lit("speaker").alias("kind"), "id", F.lit(None).cast("string").alias("text"), "start_ms", "end_ms", "speaker_id")
    # a session's own order: its events are numbered by time, speakers before lines of the same time
    return said.union(heard).withColumn("seq", F.col("at_ms") * 4096 + F.when(F.col("kind") == "speaker", 0).otherwise(2048) + F.split_part("id", F.lit("-"), F.lit(2)).cast("long") % 2048)


def named_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(lines.line_changes(line_events(spark, d))).select("session_id", "id", "speaker_id", "resolved")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return M.manifests(R.clips(spark, d), R.clip_segments(spark, d).where("id % 4 <> 3"))


def manifest_segments(spark: SparkSession, d: str) -> DataFrame:
    text = _manifests(spark, d).select(F.to_json(F.struct("*")).alias("line"))
    return M.listed(text.select(F.from_json("line", M.SCHEMA).alias("m")).select("m.*"))


def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    wanted = R.clip_segments(spark, d).where("id % 6 = 0").select("clip_id", "id")
    odd = F.transform("segments", lambda s: s.withField("file", F.when(s["id"] % 5 == 0, F.concat(F.lit("../"), s["file"])).when(s["id"] % 7 == 0, F.concat(F.lit("."), s["file"])).otherwise(s["file"])))
    return M.audio_paths(_manifests(spark, d).withColumn("segments", odd), wanted, F.concat(F.lit("clips/"), "clip_id"))


def clips_processed(spark: SparkSession, d: str) -> DataFrame:
    return M.processed(M.manifests(R.clips(spark, d), R.clip_segments(spark, d).where("id % 4 = 3")))


def unmuted_segments(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("started_at_ms")
    mutes = R.clips(spark, d).where("session_id % 2 = 0").select("session_id", start.alias("from_ms"), F.when(F.col("session_id") % 3 > 0, start + 7_200_000).alias("until_ms"))
    return M.kept_speech(R.clip_segments(spark, d), mutes).select("id", "session_id", "start_ms")


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, ".json").otherwise(".wav")
    files = R.clip_segments(spark, d).select(F.concat(F.lit("audio/"), F.col("id").cast("string"), kind).alias("path"), F.when(F.col("id") % 11 > 0, F.floor(F.col("start_ms") / 1000) + 1704067200).alias("modified_s"))
    return M.stale(files, NOW_S, 14, ".wav")


QUERIES = {f.__name__: f for f in (named_lines, manifest_segments, manifest_paths, clips_processed, unmuted_segments, stale_files)}

#: Lines and speakers in the order of arrival make a fold that SQL cannot state; tests hold it against known cases and a plain loop.
ORACLE_SQL = {
    "manifest_segments": with_sql("clip_segments", "SELECT clip_id, session_id, id, start_ms, end_ms, id || '.wav' AS file FROM clip_segments WHERE id % 4 <> 3"),
    "manifest_paths": with_sql("clip_segments", "SELECT clip_id, id, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN 'clips/' || clip_id || '/' || id || '.wav' END AS path FROM clip_segments WHERE id % 4 <> 3 AND id % 6 = 0"),
    "clips_processed": with_sql("clips clip_segments", """SELECT c.id AS clip_id, CASE WHEN count(s.id) > 0 THEN 'processed' ELSE 'empty' END AS status, CAST(count(s.id) AS INTEGER) AS n_segments
        FROM clips c LEFT JOIN clip_segments s ON s.clip_id = c.id AND s.id % 4 = 3 GROUP BY c.id"""),
    "unmuted_segments": with_sql("clips clip_segments", """SELECT id, session_id, start_ms FROM clip_segments s WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.session_id = s.session_id AND c.session_id % 2 = 0
        AND s.start_ms >= c.started_at_ms AND (c.session_id % 3 = 0 OR s.start_ms < c.started_at_ms + 7200000))"""),
    "stale_files": with_sql("clip_segments", """SELECT 'audio/' || id || '.wav' AS path, start_ms // 1000 + 1704067200 AS modified_s FROM clip_segments
        WHERE id % 3 <> 0 AND id % 11 <> 0 AND start_ms // 1000 + 1704067200 < 1706000000 - 14 * 86400"""),
}
