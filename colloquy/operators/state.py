"""Changes as functions of the state before: upserts, claims, transitions and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(state: DataFrame, items: DataFrame, key: tuple[str, str] = ("session_id", "description")) -> DataFrame:
    """The items that an insert adds if conflicts on the key do nothing: the first of each key, in
    the order of ids, whose key is not in state. A null in the key never conflicts."""
    known = state.select(*key).dropna().distinct()
    fresh = items.join(known, list(key), "left_anti")
    whole = F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    return fresh.where(~whole).unionByName(fresh.where(whole).withColumn("__place", place).where("__place = 1").drop("__place"))


def upsert_windows(state: DataFrame, windows: DataFrame) -> DataFrame:
    """state with new windows pending; the end of a known one changes only while it is pending."""
    new = windows.select("session_id", "start_ms", F.col("end_ms").alias("new_end"))
    both = state.join(new, ["session_id", "start_ms"], "full")
    end = F.when(F.col("status").isNull() | ((F.col("status") == "pending") & F.col("new_end").isNotNull()), F.col("new_end")).otherwise(F.col("end_ms"))
    return both.select("session_id", "start_ms", end.alias("end_ms"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def archived_at(old: Column, new: Column, at: Column, now: Column) -> Column:
    """When a reminder counts as archived after a change of state."""
    return F.when(old.eqNullSafe(new), at).when(new == "archived", now)


def patch(state: DataFrame, changes: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """state with the changes' values that are not null; a null keeps what was there."""
    given = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = state.join(given, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in state.columns])


def claim_next(queue: DataFrame, by: str, order: list[str], max_attempts: int) -> DataFrame:
    """queue with the first pending row of each group running and its attempts one higher. Rows with
    the most attempts are not claimed."""
    can = (F.col("status") == "pending") & (F.col("attempts") < max_attempts)
    first = queue.where(can).groupBy(by).agg(F.min(F.struct(*order)).alias("__first"))
    marked = queue.join(first, by, "left")
    taken = can & F.coalesce(F.struct(*order) == F.col("__first"), F.lit(False))
    return marked.withColumn("__taken", taken).withColumn("status", F.when(F.col("__taken"), "running").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + F.col("__taken").cast("int")).drop("__first", "__taken")


def finish(queue: DataFrame, outcome: Column, max_attempts: int = 3) -> DataFrame:
    """Running rows end as their outcome says; a failure goes back to pending until the most
    attempts are made; retry gives the row back as it is."""
    running = F.col("status") == "running"
    failed = F.when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    ended = F.when(outcome == "failed", failed).when(outcome == "retry", "pending").otherwise(outcome)
    return queue.withColumn("status", F.when(running, ended).otherwise(F.col("status")))


def requeue_stale(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def mark_self(speakers: DataFrame, tenant: Column | str, speaker: Column | str) -> DataFrame:
    """One speaker of a tenant is its own self, all others of the tenant are not."""
    return speakers.withColumn("is_self", F.when(F.col("tenant_id") == tenant, F.col("id") == speaker).otherwise(F.col("is_self")))


def replace_links(bridge: DataFrame, changed: DataFrame) -> DataFrame:
    """bridge with the label lists of the changed reminders (id, label_ids) put in place of theirs."""
    kept = bridge.join(changed.select(F.col("id").alias("reminder_id")), "reminder_id", "left_anti")
    new = changed.select(F.col("id").alias("reminder_id"), F.explode(F.array_distinct("label_ids")).alias("label_id"))
    return kept.unionByName(new)


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """rows whose key is not deleted (deleted: id): a delete, and its cascade to what refers to it."""
    return rows.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def unlink(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """rows with a reference to something deleted set to null."""
    gone = deleted.select(F.col("id").alias(key), F.lit(True).alias("__gone"))
    return rows.join(gone, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone").select(*rows.columns)
