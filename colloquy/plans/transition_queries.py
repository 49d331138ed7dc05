"""The registered queries over windows and clips on their way to reminders, and clips as they are recorded, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import extraction, intervals, relational, transitions
from colloquy.plans.store_queries import _INSIDE, _ITEMS, _LATEST, _LINES, _OVERLAPS, SHORT
from colloquy.sources import relations as R
from colloquy.sources.relations import with_sql
from colloquy.streaming import clips

NOW_S = 1_706_000_000


def unsteady(lines: DataFrame) -> DataFrame:
    """A provider that is switched off for some sessions and busy for others."""
    session = F.col("session_id")
    error = F.when(session % 11 == 0, transitions.DISABLED).when(session % 7 == 0, "busy")
    items = extraction.items_of_long_lines(lines.where(error.isNull()))
    return items.unionByName(lines.where(error.isNotNull()).select("session_id", "window_start", error.alias("error")).distinct(), allowMissingColumns=True)


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Windows as a queue, attributed lines, starts of sessions (some are missing) and labels."""
    lines = R.transcripts(spark, d)
    step = F.floor(F.col("start_ms") / 45_000)
    state = (F.col("session_id") + step) % 6
    queue = intervals.final_windows(relational.latest_final(lines), SHORT).select(
        F.concat_ws("-", "session_id", "start_ms").alias("id"), "session_id", "start_ms", "end_ms", F.when(state == 5, "running").when(state == 4, "succeeded").otherwise("pending").alias("status"),
        (step % 5).cast("int").alias("attempts"), (F.col("session_id") * 3600).alias("created_s"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("long").alias("finished_s"),
    )
    starts = R.sessions(spark, d).where("id % 13 <> 0").select(F.col("id").alias("session_id"), (F.col("started_s") * 1000).alias("started_ms"))
    labels = R.speakers(spark, d).select("id", F.col("display_name").alias("name"))
    return queue, intervals.attributed_lines(lines, R.segments(spark, d), R.speakers(spark, d)), starts, labels


def _round(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queue, lines, starts, labels = inputs(spark, d)
    claimed = transitions.claim(queue.withColumn("tenant", F.col("session_id") % 4), "tenant", 20).drop("tenant")
    heard = extraction.heard_lines(transitions.ready(claimed, starts), lines, SHORT)
    stored = R.transcripts(spark, d).where("session_id % 10 = 0").select("session_id", F.col("text").alias("description"))
    return transitions.settle(claimed, heard, unsteady(heard), starts, labels, stored, NOW_S)


def window_round(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d)[0].select("id", "status", "attempts", "last_error", "finished_s")


def round_reminders(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d)[1].select("id", "session_id", "window_start", "title", "status", "speaker_id", "source_ms")


def clip_items(spark: SparkSession, d: str) -> DataFrame:
    """Each session in clips of eight segments; lines without a segment are in none."""
    lines = R.transcripts(spark, d)
    segments = R.segments(spark, d).withColumn("clip_id", F.concat_ws("-", "session_id", F.floor(F.col("start_ms") / 240_000)))
    parts = segments.groupBy(F.col("clip_id").alias("id"), "session_id").agg(F.min("start_ms").alias("started_at_ms"))
    starts = R.sessions(spark, d).select(F.col("id").alias("session_id"), (F.col("started_s") * 1000).alias("started_ms"))
    attributed = intervals.attributed_lines(lines, R.segments(spark, d), R.speakers(spark, d))
    spoken = attributed.join(lines.select("id", "segment_id"), "id") if "segment_id" not in attributed.columns else attributed
    none = lines.limit(0).select("session_id", F.col("text").alias("description"))
    labels = R.speakers(spark, d).select("id", F.col("display_name").alias("name"))
    made = transitions.clip_reminders(parts, segments.select("id", "clip_id"), spoken, starts, labels, none, unsteady, SHORT)
    return made.select("id", "session_id", "window_start", "status", "speaker_id", "source_ms")


def recorded_clips(spark: SparkSession, d: str) -> DataFrame:
    rows = R.clip_segments(spark, d)
    events = rows.select("session_id", "id", F.when(F.col("id") % 41 == 0, "mute").otherwise("speech").alias("kind"), "start_ms", "end_ms", (F.col("id") % 13 != 0).alias("archived"))
    made = clips.clip_manifests(events, 2**60)
    return made.select("clip_id", "session_id", "started_at_ms", "ended_at_ms", "closed_at_ms", F.to_json("segments").alias("segments"))


QUERIES = {f.__name__: f for f in (window_round, round_reminders, clip_items, recorded_clips)}

_ROUND = f""", {_OVERLAPS}, {_LINES}, {_LATEST}, {_INSIDE},
    good AS (SELECT * FROM ({_ITEMS} FROM inside WHERE length(text) > 200) WHERE word IN ('high', 'medium') AND quote IS NOT NULL AND trim(text) <> ''),
    queue AS (SELECT session_id || '-' || window_start AS id, session_id, window_start, CASE (session_id + window_start // 45000) % 6 WHEN 5 THEN 'running' WHEN 4 THEN 'succeeded' ELSE 'pending' END AS status, (window_start // 45000) % 5 AS attempts, session_id * 3600 AS created_s FROM windows),
    claims AS (SELECT *, status = 'pending' AND row_number() OVER (PARTITION BY session_id % 4, status = 'pending' ORDER BY created_s, window_start, id) <= 20 AS claimed FROM queue),
    tried AS (SELECT *, attempts + CAST(claimed AS BIGINT) AS tries, EXISTS (SELECT 1 FROM inside i WHERE i.session_id = c.session_id AND i.window_start = c.window_start) AS heard,
        EXISTS (SELECT 1 FROM good g WHERE g.session_id = c.session_id AND g.window_start = c.window_start) AS fruitful FROM claims c),
    settled AS (SELECT *, CASE WHEN NOT claimed THEN NULL WHEN tries > 3 THEN 'max attempts exceeded' WHEN session_id % 13 = 0 THEN 'session lookup' WHEN heard AND session_id % 11 = 0 THEN 'llm disabled' WHEN heard AND session_id % 7 = 0 THEN 'llm error: busy' END AS last_error FROM tried),
    ended AS (SELECT *, CASE WHEN NOT claimed THEN status WHEN starts_with(last_error, 'llm') THEN 'pending' WHEN last_error IS NOT NULL THEN 'failed' WHEN fruitful THEN 'succeeded' ELSE 'empty' END AS after FROM settled)"""

#: recorded_clips is a fold; tests hold it against a plain loop.
ORACLE_SQL = {
    "window_round": with_sql("transcripts segments speakers", f"{_ROUND} SELECT id, after AS status, CAST(tries AS INTEGER) AS attempts, last_error, CASE WHEN claimed AND after <> 'pending' THEN {NOW_S} END AS finished_s FROM ended"),
    "round_reminders": with_sql("transcripts segments speakers sessions", f"""{_ROUND},
        origin AS (SELECT g.item_id, arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS speaker, min(l.start_ms) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS ms,
            arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE lower(l.speaker_name) = lower(g.speaker_name) AND lower(g.speaker_name) <> 'unknown') AS named
            FROM good g JOIN inside l ON l.session_id = g.session_id AND l.window_start = g.window_start GROUP BY g.item_id)
        SELECT g.item_id AS id, g.session_id, g.window_start, g.title, CASE g.word WHEN 'high' THEN 'open' ELSE 'pending' END AS status, coalesce(o.speaker, o.named) AS speaker_id, s.started_s * 1000 + coalesce(o.ms, g.window_start) AS source_ms
        FROM good g JOIN origin o ON o.item_id = g.item_id JOIN sessions s ON s.id = g.session_id JOIN ended e ON e.session_id = g.session_id AND e.window_start = g.window_start AND e.claimed AND e.after = 'succeeded'
        WHERE NOT EXISTS (SELECT 1 FROM transcripts t WHERE t.session_id % 10 = 0 AND t.session_id = g.session_id AND t.text = trim(g.text))
        QUALIFY row_number() OVER (PARTITION BY g.session_id, trim(g.text) ORDER BY g.item_id) = 1"""),
    "clip_items": with_sql("transcripts segments speakers sessions", f""", {_OVERLAPS}, {_LINES},
        placed AS (SELECT l.*, t.segment_id, g.start_ms // 240000 AS part FROM lines l JOIN transcripts t ON t.id = l.id JOIN segments g ON g.id = t.segment_id),
        parts AS (SELECT session_id, start_ms // 240000 AS part, min(start_ms) AS window_start FROM segments GROUP BY ALL),
        met AS (SELECT p.window_start, l.*, sum(strlen(l.text)) OVER (PARTITION BY l.session_id, l.part) AS n_bytes FROM placed l JOIN parts p ON p.session_id = l.session_id AND p.part = l.part), inside AS (SELECT * FROM met WHERE n_bytes >= 60),
        good AS (SELECT * FROM ({_ITEMS} FROM inside WHERE length(text) > 200 AND session_id % 11 <> 0 AND session_id % 7 <> 0) WHERE word IN ('high', 'medium') AND quote IS NOT NULL AND trim(text) <> ''),
        origin AS (SELECT g.item_id, arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS speaker, min(l.start_ms) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS ms,
            arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE lower(l.speaker_name) = lower(g.speaker_name) AND lower(g.speaker_name) <> 'unknown') AS named
            FROM good g JOIN inside l ON l.session_id = g.session_id AND l.window_start = g.window_start GROUP BY g.item_id)
        SELECT g.item_id AS id, g.session_id, g.window_start, CASE g.word WHEN 'high' THEN 'open' ELSE 'pending' END AS status, coalesce(o.speaker, o.named) AS speaker_id, s.started_s * 1000 + coalesce(o.ms, g.window_start) AS source_ms
        FROM good g JOIN origin o ON o.item_id = g.item_id LEFT JOIN sessions s ON s.id = g.session_id QUALIFY row_number() OVER (PARTITION BY g.session_id, trim(g.text) ORDER BY g.item_id) = 1"""),
}
