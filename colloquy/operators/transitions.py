"""Windows and clips on their way to reminders: claimed, judged and settled, in one commit that can be repeated.

A queue of windows (id, session_id, start_ms, end_ms, status, attempts, created_s, last_error, finished_s)
changes as a whole from one version to the next. What a provider answers is written before anything is
derived from it, so that a commit that is made again neither asks again nor changes anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.config import DEFAULTS, Settings
from colloquy.operators import extraction, state

#: How often a window is tried, and how many windows a round takes.
MAX_ATTEMPTS, PER_ROUND = 3, 5
#: Why a window fails or waits.
TIRED, NO_SESSION, DISABLED, FAILED = "max attempts exceeded", "session lookup", "llm disabled", "llm error: "


def claim(queue: DataFrame, by: str | None = None, most: int = PER_ROUND) -> DataFrame:
    """queue with the oldest pending windows (of each value of by) running, their attempts one higher, and claimed true."""
    pending = queue.where("status = 'pending'")
    order = ["created_s", "start_ms", "id"]
    if by is None:
        chosen = pending.orderBy(*order).limit(most).select("id")
    else:
        chosen = pending.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__place") <= most).select("id")
    marked = queue.join(chosen.withColumn("claimed", F.lit(True)), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return marked.withColumns({"status": F.when(F.col("claimed"), "running").otherwise(F.col("status")), "attempts": F.col("attempts") + F.col("claimed").cast("int")})


def ready(claimed: DataFrame, starts: DataFrame) -> DataFrame:
    """The claimed windows that a provider is asked about: not tried too often, of a known session."""
    return claimed.where(F.col("claimed") & (F.col("attempts") <= MAX_ATTEMPTS)).join(starts.select("session_id"), "session_id", "left_semi")


def settle(claimed: DataFrame, heard: DataFrame, found: DataFrame, starts: DataFrame, labels: DataFrame, stored: DataFrame, now_s: int) -> tuple[DataFrame, DataFrame]:
    """The queue after a round, and the reminders that it adds.

    heard: lines of the windows in which enough is said; found: the provider's items of them, or error for a
    window that it could not answer: those go back to pending with the reason, their items are not used. Windows tried
    too often or without a session fail; those that give nothing usable are empty; all others succeeded, even if
    every reminder is there already.
    """
    window = ["session_id", "window_start"]
    errors = found.where("error IS NOT NULL").groupBy(*window).agg(F.min("error").alias("error"))
    made = extraction.reminders_of(found.where("error IS NULL").join(errors, window, "left_anti"), heard, starts, labels)
    fruitful = made.select(*window).distinct().withColumn("fruitful", F.lit(True))
    known = starts.select("session_id").distinct().withColumn("known", F.lit(True))
    rows = claimed.withColumn("window_start", F.col("start_ms")).join(errors, window, "left").join(fruitful, window, "left").join(known, "session_id", "left")
    reason = F.when(F.col("attempts") > MAX_ATTEMPTS, TIRED).when(F.col("known").isNull(), NO_SESSION).when(F.col("error") == DISABLED, DISABLED).otherwise(F.concat(F.lit(FAILED), "error"))
    failed = (F.col("attempts") > MAX_ATTEMPTS) | F.col("known").isNull()
    status = F.when(failed, "failed").when(F.col("error").isNotNull(), "pending").when(F.col("fruitful"), "succeeded").otherwise("empty")
    new = {
        "status": F.when(F.col("claimed"), status).otherwise(F.col("status")),
        "last_error": F.when(F.col("claimed"), F.coalesce(reason, "last_error")).otherwise(F.col("last_error")),
        "finished_s": F.when(F.col("claimed") & (status != "pending"), F.lit(now_s)).otherwise(F.col("finished_s")),
    }
    after = rows.withColumns(new).select(*[c for c in claimed.columns if c != "claimed"])
    return after, state.insert_new(stored, made)


def with_errors(found: DataFrame) -> DataFrame:
    """A provider's items with the column error, for one that never fails."""
    return found if "error" in found.columns else found.withColumn("error", F.lit(None).cast("string"))


class Ledger:
    """Versions of the queue and the reminders in a shared folder, one for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _once(self, make: Callable[[], DataFrame], path: str) -> DataFrame:
        """What make gave when it was first written; it is not called again."""
        if not self._there(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def begin(self, queue: DataFrame, stored: DataFrame) -> None:
        """Version -1; a ledger that has begun stays as it is."""
        self._once(lambda: queue, f"{self.folder}/queue/v=-1")
        self._once(lambda: stored, f"{self.folder}/reminders/v=-1")

    def version(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v={batch}")

    def commit(self, batch: int, arrived: DataFrame, lines: DataFrame, starts: DataFrame, labels: DataFrame, extract: extraction.ItemExtractor, now_s: int, by: str | None = None, most: int = PER_ROUND, settings: Settings = DEFAULTS) -> None:
        """One round: windows that arrived (session_id, start_ms, end_ms and the queue's other columns) join the
        queue, the oldest are claimed, the provider is asked, and the next version is written.

        Everything follows from the version before, the batch and the provider's answers, which are written
        once: called again with the same batch (foreachBatch after a failure) it gives the same version.
        """
        queue, stored = self.version("queue", batch - 1), self.version("reminders", batch - 1)
        fresh = arrived.select(*queue.columns).join(queue.select("session_id", "start_ms"), ["session_id", "start_ms"], "left_anti").dropDuplicates(["session_id", "start_ms"]).select(*queue.columns)
        ends = arrived.groupBy("session_id", "start_ms").agg(F.max("end_ms").alias("new_end"))
        grown = queue.join(ends, ["session_id", "start_ms"], "left").withColumn("end_ms", F.when((F.col("status") == "pending") & F.col("new_end").isNotNull(), F.col("new_end")).otherwise(F.col("end_ms"))).select(*queue.columns)
        claimed = self._once(lambda: claim(grown.unionByName(fresh), by, most), f"{self.folder}/claimed/v={batch}")
        heard = extraction.heard_lines(ready(claimed, starts), lines, settings)
        found = self._once(lambda: with_errors(extract(heard)), f"{self.folder}/answers/v={batch}")
        after, made = settle(claimed, heard, found, starts, labels, stored.select("session_id", "description"), now_s)
        self._once(lambda: stored.unionByName(made.select(*stored.columns)), f"{self.folder}/reminders/v={batch}")
        self._once(lambda: after.select(*queue.columns), f"{self.folder}/queue/v={batch}")


def clip_lines(clips: DataFrame, segments: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Lines of clips (id, session_id, started_at_ms) in which enough is said, as heard_lines gives them of windows: a
    line belongs to the clip of its segment (segments: id, clip_id), whatever its time."""
    placed = lines.join(segments.select(F.col("id").alias("segment_id"), "clip_id"), "segment_id")
    inside = placed.join(clips.select(F.col("id").alias("clip_id"), F.col("started_at_ms").alias("window_start")), "clip_id")
    spoken = inside.groupBy("clip_id").agg(F.sum(F.octet_length("text")).alias("n_bytes")).where(F.col("n_bytes") >= settings.min_window_bytes)
    return inside.join(spoken.select("clip_id"), "clip_id", "left_semi")


def clip_reminders(clips: DataFrame, segments: DataFrame, lines: DataFrame, starts: DataFrame, labels: DataFrame, stored: DataFrame, extract: extraction.ItemExtractor, settings: Settings = DEFAULTS) -> DataFrame:
    """The reminders that clips add. A clip has no state of its own for this: what fails is left out."""
    heard = clip_lines(clips, segments, lines, settings)
    found = with_errors(extract(heard))
    usable = found.where("error IS NULL").join(found.where("error IS NOT NULL").select("session_id", "window_start"), ["session_id", "window_start"], "left_anti")
    return state.insert_new(stored, extraction.reminders_of(usable, heard, starts, labels))
