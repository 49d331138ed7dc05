"""Joins of time intervals within sessions, windows over time, and runs of equal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.config import DEFAULTS, Settings

#: Milliseconds of the grid on which intervals meet.
GRID_MS = 60_000


def _cells(start: Column, end: Column) -> Column:
    cell = lambda t: F.floor(t / GRID_MS)
    return F.explode(F.sequence(cell(start), F.greatest(cell(end), cell(start))))


def overlapping(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """(line_id, first overlapping segment's speaker) of lines that overlap a segment of their
    session for some time; touching is not enough. First: by start, then id.

    Both sides lie in grid cells, so the join is on (session, cell) and long sessions spread out.
    """
    left = lines.select("session_id", F.col("id").alias("line_id"), "start_ms", "end_ms", _cells(F.col("start_ms"), F.col("end_ms")).alias("cell"))
    right = segments.select("session_id", F.struct(F.col("start_ms").alias("start"), F.col("id").alias("seg_id"), F.col("end_ms").alias("end"), "speaker_id").alias("seg"), _cells(F.col("start_ms"), F.col("end_ms")).alias("cell"))
    met = left.join(right, ["session_id", "cell"]).where((F.col("start_ms") < F.col("seg.end")) & (F.col("end_ms") > F.col("seg.start")))
    return met.groupBy("line_id").agg(F.min("seg").alias("seg")).select("line_id", F.col("seg.seg_id").alias("overlap_segment"), F.col("seg.speaker_id").alias("overlap_speaker"))


def attributed_lines(transcripts: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Final lines with their speaker: the linked segment's, else the first overlapping one's."""
    lines = transcripts.where("is_final")
    unlinked = overlapping(lines.where("segment_id IS NULL"), segments)
    direct = segments.select(F.col("id").alias("segment_id"), F.col("speaker_id").alias("direct_speaker"))
    found = lines.join(direct, "segment_id", "left").join(unlinked, lines["id"] == unlinked["line_id"], "left").withColumn("speaker_id", F.coalesce("direct_speaker", "overlap_speaker"))
    names = speakers.select(F.col("id").alias("speaker_id"), "display_name")
    return found.join(names, "speaker_id", "left").select("session_id", "id", "start_ms", "end_ms", "text", "speaker_id", F.coalesce("display_name", F.lit("Unknown")).alias("speaker_name"))


def midpoint_speakers(lines: DataFrame, events: DataFrame) -> DataFrame:
    """The first event, by arrival and then id, whose interval holds a line's midpoint, ends
    included; (id, event_id, kind), null without one."""
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    left = lines.select("session_id", "id", mid.alias("mid"), F.floor(mid / GRID_MS).alias("cell"))
    right = events.select("session_id", F.struct(F.col("start_ms").alias("start"), F.col("id").alias("event_id"), F.col("end_ms").alias("end"), "kind").alias("event"), _cells(F.col("start_ms"), F.col("end_ms")).alias("cell"))
    met = left.join(right, ["session_id", "cell"]).where(F.col("mid").between(F.col("event.start"), F.col("event.end")))
    first = met.groupBy("id").agg(F.min("event").alias("event"))
    return lines.select("id").join(first, "id", "left").select("id", F.col("event.event_id").alias("event_id"), F.col("event.kind").alias("kind"))


def live_windows(latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Windows that end before the latest final line less the late margin (latest: session_id,
    latest_end_ms)."""
    cutoff = F.col("latest_end_ms") - settings.late_margin_ms
    rows = latest.where(cutoff >= settings.window_ms)
    start = F.explode(F.sequence(F.lit(0).cast("long"), cutoff - settings.window_ms, F.lit(settings.window_step_ms).cast("long")))
    return rows.select("session_id", start.alias("start_ms")).withColumn("end_ms", F.col("start_ms") + settings.window_ms)


def final_windows(latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Windows of ended sessions: all that start before the latest final line, a short last one too."""
    rows = latest.where("latest_end_ms > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("latest_end_ms") - 1, F.lit(settings.window_step_ms).cast("long")))
    return rows.select("session_id", start.alias("start_ms")).withColumn("end_ms", F.col("start_ms") + settings.window_ms)


def window_lines(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that overlap each window for some time.

    Both lie in grid cells and meet by (session, cell); a pair counts in the first cell that both
    have, so it comes once, and long sessions spread over tasks.
    """
    w = windows.select("session_id", F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end"), _cells(F.col("start_ms"), F.col("end_ms")).alias("cell"))
    met = w.join(lines.withColumn("cell", _cells(F.col("start_ms"), F.col("end_ms"))), ["session_id", "cell"])
    first = F.floor(F.greatest("start_ms", "window_start") / GRID_MS)
    return met.where((F.col("start_ms") < F.col("window_end")) & (F.col("end_ms") > F.col("window_start")) & (F.col("cell") == first)).drop("cell")


def clock(ms: Column) -> Column:
    """HH:MM:SS; hours don't wrap."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def window_prompts(windows: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each window's attributed lines as one text, with its bytes of speech; windows with less
    speech than the least are left out."""
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" • "), F.col("speaker_name"), F.lit("]: "), F.col("text"))
    grouped = window_lines(windows, lines).groupBy("session_id", "window_start").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.array_sort(F.collect_list(F.struct("start_ms", "id", line.alias("line")))).alias("l"))
    return grouped.where(F.col("n_bytes") >= settings.min_window_bytes).select("session_id", "window_start", "n_bytes", F.array_join(F.col("l.line"), "\n").alias("prompt"))


def runs(rows: DataFrame, by: str, order: list[str], same: list[str]) -> DataFrame:
    """Runs of neighbours that agree in the same columns: by, those columns, run (from 1), n_rows,
    start_ms and end_ms. A run is known by its place alone, so equal runs apart stay apart."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.lag(F.struct(*same)).over(w)
    fresh = F.when(before.isNull() | ~before.eqNullSafe(F.struct(*same)), 1).otherwise(0)
    marked = rows.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run", *same).agg(F.count("*").alias("n_rows"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
