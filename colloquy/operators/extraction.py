"""Windows of a session turned into reminders: the provider's items cleaned, judged, matched to lines and stored."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.config import DEFAULTS, Settings
from colloquy.functions import text
from colloquy.operators import intervals, state

#: What a model writes for no value, and its words for priorities and confidences.
NO_VALUE = ("None", "none", "null", "N/A", "n/a", "unknown", "")
PRIORITY = {"high": ("high", "h", "urgent", "critical"), "medium": ("medium", "med", "m", "normal", "moderate"), "low": ("low", "l", "minor")}
CONFIDENCE = {"high": ("high", "h"), "medium": ("medium", "med", "m"), "low": ("low", "l")}


class ItemExtractor(Protocol):
    """A provider: from lines of windows (session_id, window_start, id, start_ms, end_ms, text, speaker_id, speaker_name) to
    items (item_id, session_id, window_start, title, description, priority, due_time, labels, confidence, evidence_quote,
    speaker_name). A model is called inside mapInPandas; the default works by rule."""

    def __call__(self, lines: DataFrame) -> DataFrame: ...


#: Formats of a due time with a time of day.
DUE_FORMATS = ("yyyy-M-d'T'H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d H:m:s", "M/d/yyyy H:m")


def items_of_long_lines(lines: DataFrame) -> DataFrame:
    """The default provider, by rule: each line of more than 200 characters is an item that quotes its first 24."""
    n = F.length("text")
    word = F.element_at(F.array(F.lit(" High "), F.lit("med"), F.lit("l"), F.lit("unknown")), (n % 4 + 1).cast("int"))
    return lines.where(n > 200).select(
        F.concat_ws("-", "session_id", "window_start", "id").alias("item_id"), "session_id", "window_start",
        F.when(n % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit(" About "), F.left("text", F.lit(10)))).alias("title"), F.col("text").alias("description"),
        word.alias("priority"), F.when(n % 2 == 0, "2024-03-05T14:30").alias("due_time"), F.array(F.lit("none"), F.upper("speaker_name")).alias("labels"),
        word.alias("confidence"), F.when(n % 5 == 0, F.lit("  ")).otherwise(F.lower(F.left("text", F.lit(24)))).alias("evidence_quote"), "speaker_name",
    )


def _word(column: Column, words: dict[str, tuple[str, ...]]) -> Column:
    low, out = F.lower(F.trim(column)), F.lit(None).cast("string")
    for name, said in words.items():
        out = F.when(low.isin(*said), name).otherwise(out)
    return F.when(~column.isin(*NO_VALUE), out)


def _value(column: Column) -> Column:
    """Trimmed; null if nothing or a word for nothing is left."""
    return F.when(~F.trim(column).isin(*NO_VALUE), F.trim(column))


def normalised(items: DataFrame) -> DataFrame:
    """Items with clean fields: words for nothing are null, priorities and confidences have their own names, due times
    that no format reads go, labels are trimmed."""
    labels = F.filter(F.transform("labels", lambda w: F.trim(w)), lambda w: ~w.isin(*NO_VALUE))
    new = {
        "title": F.when(~F.col("title").isin(*NO_VALUE) & (F.trim("title") != ""), F.trim("title")), "description": F.trim("description"),
        "priority": _word(F.col("priority"), PRIORITY), "due_time": due_text(F.col("due_time")), "labels": F.coalesce(labels, F.array().cast("array<string>")),
        "confidence": _word(F.col("confidence"), CONFIDENCE), "evidence_quote": _value(F.col("evidence_quote")), "speaker_name": _value(F.col("speaker_name")),
    }
    return items.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def due_text(column: Column) -> Column:
    """A due time in one of the known formats as it is, a date alone at nine; else null. Months, days, hours and
    minutes may have one digit; a date with slashes alone is written anew."""
    t = F.when(~column.isin(*NO_VALUE), F.trim(column))
    read = lambda f: F.try_to_timestamp(t, F.lit(f))
    whole = F.coalesce(*map(read, DUE_FORMATS))
    slashes = F.date_format(read("M/d/yyyy"), "yyyy-MM-dd'T'09:00")
    return F.when(whole.isNotNull(), t).when(read("yyyy-M-d").isNotNull(), F.concat(t, F.lit("T09:00"))).otherwise(slashes)


def usable(items: DataFrame) -> DataFrame:
    """Items with a description and a quote, and with a status: high confidence is open, medium pending, all else goes."""
    status = text.status_by_confidence(F.col("confidence"))
    return items.withColumn("status", status).where("description <> '' AND evidence_quote IS NOT NULL AND status IS NOT NULL")


def speakers_of_items(items: DataFrame, lines: DataFrame) -> DataFrame:
    """items with the speaker and start of the first line of their window that holds the quote, without regard to case;
    without one, with the speaker of the first line under the item's speaker name,
    in which only ASCII letters are alike in both cases."""
    place = ["session_id", "window_start"]
    here = lines.select(*place, F.struct("start_ms", "id", "speaker_id").alias("line"), F.lower("text").alias("line_text"), text.ascii_lower(F.col("speaker_name")).alias("line_name"))
    quoted = items.select("item_id", *place, F.lower("evidence_quote").alias("quote")).join(here, place).where(F.col("line_text").contains(F.col("quote"))).groupBy("item_id").agg(F.min("line").alias("by_quote"))
    name = items.withColumn("line_name", text.ascii_lower(F.col("speaker_name"))).where("line_name <> 'unknown'").select("item_id", *place, "line_name")
    named = name.join(here, [*place, "line_name"]).groupBy("item_id").agg(F.min("line").alias("by_name"))
    found = items.join(quoted, "item_id", "left").join(named, "item_id", "left")
    return found.withColumn("speaker_id", F.coalesce("by_quote.speaker_id", "by_name.speaker_id")).withColumn("origin_ms", F.col("by_quote.start_ms")).drop("by_quote", "by_name")


def process_windows(windows: DataFrame, lines: DataFrame, starts: DataFrame, labels: DataFrame, stored: DataFrame, extract: ItemExtractor = items_of_long_lines, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The reminders that windows add, and each window's state after (session_id, start_ms, status).

    lines: attributed lines; starts: session_id, started_ms; labels: id, name; stored: session_id, description. Windows
    with too little speech are empty, all others succeeded. Of equal descriptions in a session the first counts.
    """
    heard = heard_lines(windows, lines, settings)
    made = reminders_of(extract(heard), heard, starts, labels)
    spoken = heard.select("session_id", F.col("window_start").alias("start_ms"), F.lit("succeeded").alias("s")).distinct()
    after = windows.join(spoken, ["session_id", "start_ms"], "left")
    return state.insert_new(stored, made), after.select("session_id", "start_ms", F.coalesce("s", F.lit("empty")).alias("status"))


def heard_lines(windows: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The lines of windows in which enough is said."""
    inside = intervals.window_lines(windows, lines)
    spoken = inside.groupBy("session_id", "window_start").agg(F.sum(F.octet_length("text")).alias("n_bytes")).where(F.col("n_bytes") >= settings.min_window_bytes)
    return inside.join(spoken.select("session_id", "window_start"), ["session_id", "window_start"], "left_semi")


def reminders_of(found: DataFrame, heard: DataFrame, starts: DataFrame, labels: DataFrame) -> DataFrame:
    """Reminders of a provider's items, with the speaker and time of the line that they quote and the ids of their labels."""
    items = speakers_of_items(usable(normalised(found)), heard).join(starts, "session_id", "left")
    known = labels.select(F.col("id").alias("label_id"), F.lower("name").alias("low"))
    names = items.select("item_id", F.explode("labels").alias("l")).join(known, F.lower("l") == F.col("low")).groupBy("item_id").agg(F.array_sort(F.collect_set("label_id")).alias("label_ids"))
    return items.join(names, "item_id", "left").select(
        F.col("item_id").alias("id"), "session_id", "window_start", "title", "description", "priority", "status", "speaker_id",
        (F.col("started_ms") + F.coalesce("origin_ms", "window_start")).alias("source_ms"), text.excerpt(F.col("evidence_quote")).alias("excerpt"),
        "due_time", F.coalesce("label_ids", F.array().cast(f"array<{dict(labels.dtypes)['id']}>")).alias("label_ids"),
    )
