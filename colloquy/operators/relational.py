"""Filters, joins, rankings and lists over reminders, clips and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States and priorities that a reminder may have; the order of priorities.
STATUSES = ("open", "pending", "completed", "archived")
PRIORITIES = ("high", "medium", "low")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_ascii(column: Column, term: str) -> Column:
    """Whether a text contains the term, A-Z without regard to case. In the term % and _ are
    wildcards, and a backslash is an ordinary character. A null text does not match."""
    pattern = "%" + term.replace("\\", "\\\\").translate(str.maketrans(_UPPER, _LOWER)) + "%"
    return F.coalesce(F.translate(column, _UPPER, _LOWER).like(pattern), F.lit(False))


def list_reminders(reminders: DataFrame, bridge: DataFrame, tenant: str, status: str | None = None, priority: str | None = None, label: str | None = None, search: str | None = None, session: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A tenant's reminders, newest first, under the conditions that are given; at most 200."""
    if status is not None and status not in STATUSES or priority is not None and priority not in PRIORITIES:
        raise ValueError("unknown status or priority")
    rows = reminders.where(F.col("tenant_id") == tenant)
    for name, value in (("status", status), ("priority", priority), ("session_id", session)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if search is not None:
        rows = rows.where(like_ascii(F.col("title"), search) | like_ascii(F.col("description"), search))
    if label is not None:
        rows = rows.join(bridge.where(F.col("label_id") == label).select(F.col("reminder_id").alias("id")), "id", "left_semi")
    return rows.orderBy(F.desc("created_s"), "id").offset(max(0, offset)).limit(max(0, min(limit, 200)))


def with_label_ids(reminders: DataFrame, bridge: DataFrame) -> DataFrame:
    """reminders with label_ids, sorted; empty without labels."""
    ids = bridge.groupBy(F.col("reminder_id").alias("id")).agg(F.array_sort(F.collect_set("label_id")).alias("label_ids"))
    return reminders.join(ids, "id", "left").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<string>")))


def label_usage(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("label_id").agg(F.count("*").alias("n_reminders"))


def trace_sources(reminders: DataFrame, clips: DataFrame, windows: DataFrame) -> DataFrame:
    """What each reminder's source_window_id points at: a clip, else a window, else nothing."""
    pool = lambda df, kind: df.select(F.col("id").alias("source_window_id"), F.struct(F.lit(kind).alias("kind"), "session_id", "start_ms").alias(kind))
    found = reminders.join(pool(clips, "clip"), "source_window_id", "left").join(pool(windows, "window"), "source_window_id", "left")
    source = F.coalesce("clip", "window")
    return found.select("id", "source_window_id", F.coalesce(source["kind"], F.lit("none")).alias("source_kind"), source["session_id"].alias("source_session"), source["start_ms"].alias("source_start_ms"))


def priority_rank(column: Column) -> Column:
    """0 for high, 1 for medium, 2 for low and for none, which counts as medium on display only."""
    return F.when(column == "high", 0).when(column == "medium", 1).otherwise(2)


def board(reminders: DataFrame, tenant: str, search: str | None = None) -> DataFrame:
    """Reminders on the board: neither archived nor pending; by priority, then newest first."""
    rows = reminders.where((F.col("tenant_id") == tenant) & ~F.col("status").isin("archived", "pending"))
    if search is not None:
        rows = rows.where(F.lower(F.concat_ws("\n", "title", "description")).contains(search.lower()))
    return rows.orderBy(priority_rank(F.col("priority")), F.desc("created_s"), "id")


def newest_unstarred(rows: DataFrame, keep: int, by: str, order: list[Column]) -> DataFrame:
    """All starred rows, and of the others the first so many of each group."""
    place = F.row_number().over(Window.partitionBy(by, "starred").orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("starred") | (F.col("__place") <= keep)).drop("__place")


def clip_texts(clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Each clip's final transcripts joined by spaces in time order; null without any."""
    lines = transcripts.where("is_final").select(F.col("session_id").alias("clip_id"), "start_ms", "id", "text")
    texts = lines.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "id", "text"))).alias("l"))
    return clips.join(texts, clips["id"] == texts["clip_id"], "left").select("id", F.array_join(F.col("l.text"), " ").alias("text"))


def latest_final(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("session_id").agg(F.max(F.when(F.col("is_final"), F.col("end_ms"))).alias("latest_end_ms"))


def matching_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Label ids of each item's label names, without regard to case; unknown names are dropped."""
    names = items.select("id", F.explode("labels").alias("name"))
    known = labels.select(F.col("id").alias("label_id"), F.lower("name").alias("known"))
    hits = names.join(known, F.lower("name") == F.col("known")).groupBy("id").agg(F.array_sort(F.collect_set("label_id")).alias("label_ids"))
    return items.select("id").join(hits, "id", "left").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<string>")))
