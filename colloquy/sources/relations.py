"""The engine's relations, drawn from the generated tables.

Conversations give transcripts, segments and speakers; documents with labels give reminders and
their label bridge; events give timed segments of users; embeddings give voice vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the same relations, for DuckDB.
SQL = {
    "transcripts": """SELECT conv_id AS session_id, conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn END AS segment_id,
        turn * 15000 AS start_ms, turn * 15000 + 5000 + length(text) % 9000 AS end_ms, text, turn % 5 <> 4 AS is_final FROM conversations""",
    "segments": """SELECT conv_id AS session_id, conv_id || '-' || turn AS id, turn * 15000 AS start_ms, turn * 15000 + 22000 AS end_ms, role AS speaker_id
        FROM conversations WHERE turn % 2 = 0""",
    "speakers": "SELECT DISTINCT role AS id, upper(role) AS display_name FROM conversations WHERE role <> 'system'",
    "reminders": """SELECT d.doc_id AS id, d.source AS tenant_id, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id % 50 END AS session_id,
        CASE WHEN d.doc_id % 5 <> 0 THEN 'Note ' || d.lang || ' ' || d.doc_id END AS title, d.text AS description,
        CASE WHEN l.toxic = 1 THEN 'archived' WHEN l.quality = 1 THEN 'open' WHEN l.quality = 0 THEN 'completed' ELSE 'pending' END AS status,
        CASE d.n_chars % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS priority, d.doc_id * 60 AS created_s,
        CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 40 || '-' || d.doc_id % 8 END AS source_window_id
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "reminder_labels": "SELECT doc_id AS reminder_id, 'quality' AS label_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1",
    "user_segments": """SELECT user_id AS session_id, event_id AS id, epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
        epoch_us(ts) // 1000 - 1704067200000 + 1000 + CAST(floor(abs(value) * 100) AS BIGINT) % 9000 AS end_ms, event_type AS kind, value FROM events""",
    "sessions": """SELECT conv_id AS id, 'src' || conv_id % 4 AS tenant_id, CASE WHEN conv_id % 3 = 0 THEN 'always_on' ELSE 'manual' END AS mode, conv_id * 3600 AS started_s,
        CASE WHEN conv_id % 5 <> 0 THEN conv_id * 3600 + max(turn) * 15 + 60 END AS ended_s FROM conversations GROUP BY conv_id""",
    "people": """SELECT c_custkey AS id, 'src' || c_nationkey % 4 AS tenant_id, c_name AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'provisional' ELSE 'enrolled' END AS kind,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 1000 END AS last_matched_s, c_custkey % 50 = 0 AS is_self FROM customer""",
    "clip_segments": """SELECT event_id AS id, user_id AS session_id, user_id || '-' || (epoch_us(ts) // 1000 - 1704067200000) // 86400000 AS clip_id, epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
        epoch_us(ts) // 1000 - 1704067200000 + 1000 + CAST(floor(abs(value) * 100) AS BIGINT) % 9000 AS end_ms, CASE WHEN event_id % 4 <> 0 THEN event_type END AS speaker_id,
        CASE WHEN event_id % 3 = 0 THEN 'audio-' || event_id END AS audio_ref, event_id % 5 <> 0 AS has_vector, CASE WHEN event_id % 7 = 0 THEN event_id * 10 END AS dismissed_s FROM events""",
    "clips": """SELECT user_id || '-' || (epoch_us(ts) // 1000 - 1704067200000) // 86400000 AS id, user_id AS session_id, min(epoch_us(ts) // 1000 - 1704067200000) AS started_at_ms,
        max(epoch_us(ts) // 1000 - 1704067200000) + 5000 AS ended_at_ms, count(*) AS segment_count,
        CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'processed' ELSE 'empty' END AS status FROM events GROUP BY ALL""",
    "named_labels": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'src' || n_regionkey AS tenant_id, n_name AS name FROM nation",
    "voices": "SELECT vec_id AS id, label AS speaker_id, embedding FROM embeddings",
}


def with_sql(names: str, body: str) -> str:
    """A DuckDB query whose WITH clause defines the named relations; body may go on with more."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, key = F.col("turn"), F.concat_ws("-", "conv_id", "turn")
    return _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), key.alias("id"), F.when(turn % 2 == 0, key).alias("segment_id"),
        (turn * 15000).alias("start_ms"), (turn * 15000 + 5000 + F.length("text") % 9000).alias("end_ms"), "text", (turn % 5 != 4).alias("is_final"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").where(F.col("turn") % 2 == 0)
    return rows.select(F.col("conv_id").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("turn") * 15000).alias("start_ms"), (F.col("turn") * 15000 + 22000).alias("end_ms"), F.col("role").alias("speaker_id"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("role").alias("id"), F.upper("role").alias("display_name")).distinct()


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"), F.col("source").alias("tenant_id"), F.when(i % 7 != 0, i % 50).alias("session_id"),
        F.when(i % 5 != 0, F.concat_ws(" ", F.lit("Note"), "lang", "doc_id")).alias("title"), F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 1, "open").when(F.col("quality") == 0, "completed").otherwise("pending").alias("status"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (F.col("n_chars") % 4 + 1).cast("int")).alias("priority"),
        (i * 60).alias("created_s"), F.when(i % 3 == 0, F.concat_ws("-", i % 40, i % 8)).alias("source_window_id"),
    )


def reminder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("reminder_id"), F.explode(flags).alias("label_id"))


def user_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000
    rows = _read(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), start.alias("start_ms"), (start + 1000 + F.floor(F.abs("value") * 100).cast("long") % 9000).alias("end_ms"), F.col("event_type").alias("kind"), "value")


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("speaker_id"), "embedding")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return rows.select(i.alias("id"), F.concat(F.lit("src"), i % 4).alias("tenant_id"), F.when(i % 3 == 0, "always_on").otherwise("manual").alias("mode"), (i * 3600).alias("started_s"), F.when(i % 5 != 0, i * 3600 + F.col("last") * 15 + 60).alias("ended_s"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        i.alias("id"), F.concat(F.lit("src"), F.col("c_nationkey") % 4).alias("tenant_id"), F.col("c_name").alias("display_name"), F.when(i % 3 == 0, "provisional").otherwise("enrolled").alias("kind"),
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"), F.when(i % 4 != 0, i * 1000).alias("last_matched_s"), (i % 50 == 0).alias("is_self"),
    )


def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = user_segments(spark, sf_dir)
    return rows.select(
        "id", "session_id", F.concat_ws("-", "session_id", F.floor(F.col("start_ms") / 86_400_000)).alias("clip_id"), "start_ms", "end_ms", F.when(i % 4 != 0, F.col("kind")).alias("speaker_id"),
        F.when(i % 3 == 0, F.concat(F.lit("audio-"), i)).alias("audio_ref"), (i % 5 != 0).alias("has_vector"), F.when(i % 7 == 0, i * 10).alias("dismissed_s"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "processed", "empty"))), (F.col("session_id") % 4 + 1).cast("int"))
    rows = clip_segments(spark, sf_dir).groupBy(F.col("clip_id").alias("id"), "session_id")
    return rows.agg(F.min("start_ms").alias("started_at_ms"), (F.max("start_ms") + 5000).alias("ended_at_ms"), F.count("*").alias("segment_count")).withColumn("status", status)


def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("src"), F.col("n_regionkey")).alias("tenant_id"), F.col("n_name").alias("name"))
