"""The registered queries over sessions, clips, speakers and windows, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.functions import signal, text, times
from colloquy.operators import extraction, intervals, relational, state, store
from colloquy.sources import relations as R
from colloquy.sources.relations import with_sql

SHORT = Settings(window_ms=60_000, window_step_ms=45_000, late_margin_ms=15_000)
NOW_S = 10**9


def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_open_sessions(R.sessions(spark, d))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return store.page(R.sessions(spark, d).where("tenant_id = 'src1'"), [F.desc("started_s"), F.asc("id")], 500, 100).select("id", "mode", "started_s")


def end_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = R.sessions(spark, d)
    return store.end_sessions(rows, rows.where("mode = 'always_on'").select("id"), NOW_S).select("id", "ended_s")


def active_live_windows(spark: SparkSession, d: str) -> DataFrame:
    latest = relational.latest_final(R.transcripts(spark, d))
    return intervals.live_windows(store.of_active_sessions(latest, R.sessions(spark, d)), SHORT)


def unknown_in_session(spark: SparkSession, d: str) -> DataFrame:
    return store.unknown_segments(R.clip_segments(spark, d), 7, 20).select("id", "start_ms")


def unknown_everywhere(spark: SparkSession, d: str) -> DataFrame:
    return store.unknown_segments(R.clip_segments(spark, d), None, 100).select("id", "session_id", "start_ms")


def retained_candidates(spark: SparkSession, d: str) -> DataFrame:
    return store.retained_candidates(R.clip_segments(spark, d), None, 50).select("id", "session_id", "audio_ref")


def segments_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.by_ids(R.clip_segments(spark, d), spark.range(0, 4000, 9)).select("id", "clip_id")


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.missing_ids(R.people(spark, d).select((F.col("id") * 7).alias("id")), R.people(spark, d))


def clip_archive(spark: SparkSession, d: str) -> DataFrame:
    return store.archive_clips(R.clips(spark, d), 1000).select("id", "status", "duration_ms", "segment_count")


def clip_members(spark: SparkSession, d: str) -> DataFrame:
    return R.clip_segments(spark, d).where("clip_id = '7-3'").orderBy("start_ms", "id").select("id", "start_ms", "end_ms")


def clip_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = R.clips(spark, d)
    ours = rows.where("session_id % 3 <> 0").select("id", F.lit("old").alias("text"), (F.col("segment_count") % 2 == 0).alias("starred"))
    return store.merge_clips(ours, rows.where("session_id % 2 = 0").select("id", F.col("status").alias("text")))


def speaker_list(spark: SparkSession, d: str) -> DataFrame:
    return store.active_speakers(R.people(spark, d), "src2").select("id", "display_name")


def provisional_list(spark: SparkSession, d: str) -> DataFrame:
    return store.provisional_speakers(R.people(spark, d)).select("id", "tenant_id", "last_matched_s")


def provisional_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = R.people(spark, d)
    return state.without(rows, store.stale_provisionals(rows, 3_000_000, 30), "id").select("id", "kind")


def promote_speakers(spark: SparkSession, d: str) -> DataFrame:
    rows = R.people(spark, d)
    names = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("Named "), "id")).alias("new_name"))
    return store.promote(rows, names).select("id", "display_name", "kind", "last_matched_s")


def touch_speakers(spark: SparkSession, d: str) -> DataFrame:
    rows = R.people(spark, d)
    return store.touch(rows, rows.where("id % 5 = 0"), NOW_S).select("id", "last_matched_s")


def mark_self(spark: SparkSession, d: str) -> DataFrame:
    return state.mark_self(R.people(spark, d), "src3", F.lit(8)).select("id", "is_self")


def dismiss_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = R.clip_segments(spark, d)
    return store.dismiss_segments(rows, rows.where("id % 10 = 1").select("id"), NOW_S).select("id", "audio_ref", "dismissed_s")


def assign_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = R.clip_segments(spark, d)
    given = rows.where("id % 6 = 0").select("id", F.when(F.col("id") % 12 == 0, "someone").alias("new_speaker"))
    return store.assign_segments(rows, given).select("id", "speaker_id", "audio_ref")


def upsert_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = R.clip_segments(spark, d).select("id", "session_id", "clip_id", "start_ms", "end_ms")
    new = rows.where("id % 3 <> 1").withColumn("clip_id", F.lit("new")).withColumn("start_ms", F.col("start_ms") + 1)
    return store.upsert(rows.where("id % 2 = 0"), new, ["id"], keep=("session_id", "start_ms", "end_ms"))


def replace_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = R.voices(spark, d).select("id", "speaker_id")
    return store.replace_all(rows, rows.where("speaker_id % 2 = 0 AND id % 3 = 0").withColumn("id", F.col("id") + 100_000), "speaker_id")


def rollback_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = R.voices(spark, d).select("id", "speaker_id")
    return state.without(rows, rows.where("id % 4 = 1").select("id"), "id")


def label_list(spark: SparkSession, d: str) -> DataFrame:
    return R.named_labels(spark, d).where("tenant_id = 'src2'").orderBy("name").select("id", "name")


def labels_per_tenant(spark: SparkSession, d: str) -> DataFrame:
    return R.named_labels(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n_labels"))


def seed_labels(spark: SparkSession, d: str) -> DataFrame:
    kept = R.named_labels(spark, d).where("tenant_id <> 'src1'").withColumns({"color": F.lit("#111111"), "bg_color": F.lit("#eeeeee")})
    return store.seed_labels(kept, R.sessions(spark, d).select("tenant_id"))


def matching_labels(spark: SparkSession, d: str) -> DataFrame:
    items = R.people(spark, d).select("id", F.array(F.lower("display_name"), F.element_at(F.array(*map(F.lit, ("france", "Peru", "NOWHERE"))), (F.col("id") % 3 + 1).cast("int")), F.lit("china")).alias("labels"))
    found = relational.matching_labels(items, R.named_labels(spark, d).select(F.col("id").cast("string").alias("id"), "name"))
    return found.select("id", F.array_join("label_ids", ",").alias("label_ids"))


def replace_label_links(spark: SparkSession, d: str) -> DataFrame:
    changed = R.reminders(spark, d).where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("label_ids"))
    return state.replace_links(R.reminder_labels(spark, d), changed)


def requeue_stale(spark: SparkSession, d: str) -> DataFrame:
    return state.requeue_stale(R.clips(spark, d)).select("id", "status")


def needs_review(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).where("status = 'pending'").groupBy("tenant_id").agg(F.count("*").alias("n_pending"))


def reminder_archive(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).where("status = 'archived'").orderBy(F.desc("created_s"), "id").select("id", "tenant_id", "created_s")


def board_with_label(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.board(relational.with_label_ids(R.reminders(spark, d), R.reminder_labels(spark, d)), "src1")
    return rows.where("priority = 'high' AND array_contains(label_ids, 'quality')").select("id", "status")


def tray(spark: SparkSession, d: str) -> DataFrame:
    return relational.board(R.reminders(spark, d), "src2").limit(6).select("id", "priority")


def session_reminders(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).where("session_id = 11").orderBy("created_s", "id").select("id", "title", "status")


def add_finals(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d)
    return store.add_finals(lines, R.segments(spark, d).where("session_id % 2 = 0")).select("id", "segment_id", "text")


def tagged_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d).join(R.segments(spark, d).select(F.col("id").alias("segment_id"), "speaker_id"), "segment_id", "left")
    return store.tagged_text(lines, R.speakers(spark, d)).select("id", "text")


def longest_members(spark: SparkSession, d: str) -> DataFrame:
    return store.longest_members(R.clip_segments(spark, d).withColumn("cluster", F.col("clip_id")))


def clip_gate(spark: SparkSession, d: str) -> DataFrame:
    return store.gated_clusters(R.clip_segments(spark, d).withColumn("cluster", F.col("speaker_id")), 2, 8000)


def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    vectors = R.voices(spark, d).select("id", (F.col("id") % 150).alias("person_id"), "embedding")
    pools = [store.candidate_pool(vectors, R.people(spark, d), "src1", 64, kind).select("id", "person_id", "kind") for kind in ("enrolled", "provisional")]
    return pools[0].unionByName(pools[1])


def pending_batch(spark: SparkSession, d: str) -> DataFrame:
    return store.trim_pending(R.transcripts(spark, d), "session_id").select("session_id", "id")


def changed_speakers(spark: SparkSession, d: str) -> DataFrame:
    return signal.changed(R.clip_segments(spark, d), "session_id", ["start_ms", "id"], "speaker_id").select("id", "speaker_id")


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = R.transcripts(spark, d)
    windows = intervals.final_windows(relational.latest_final(lines), SHORT)
    attributed = intervals.attributed_lines(lines, R.segments(spark, d), R.speakers(spark, d))
    starts = R.sessions(spark, d).select(F.col("id").alias("session_id"), (F.col("started_s") * 1000).alias("started_ms"))
    labels = R.speakers(spark, d).select("id", F.col("display_name").alias("name"))
    stored = lines.where("session_id % 10 = 0").select("session_id", F.col("text").alias("description"))
    return extraction.process_windows(windows, attributed, starts, labels, stored, settings=SHORT)


def process_windows(spark: SparkSession, d: str) -> DataFrame:
    made = _windows(spark, d)[0]
    due = times.due_utc(F.col("due_time"), "America/New_York")
    return made.select("id", "session_id", "window_start", "title", "priority", "status", "speaker_id", "source_ms", "excerpt", due.alias("due"), F.array_join("label_ids", ",").alias("label_ids"))


def window_states(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)[1]


def normalised_items(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d).select("session_id", F.lit(0).alias("window_start"), "id", "start_ms", "end_ms", "text", F.lit("s").alias("speaker_id"), F.lit(" Bob ").alias("speaker_name"))
    items = extraction.normalised(extraction.items_of_long_lines(lines))
    return items.select("item_id", "title", "priority", "due_time", F.array_join("labels", ",").alias("labels"), "confidence", "evidence_quote", "speaker_name")


def due_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 9
    said = F.when(k == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format(day, " yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(day, "MM/dd/yyyy")).when(k == 3, F.date_format(day, "yyyy-MM-dd")).when(k == 4, "None").when(k == 5, "next week")
    said = said.when(k == 6, F.date_format(day, "M/d/yyyy")).when(k == 7, F.date_format(day, "yyyy-M-d")).otherwise(F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 9:05")))
    return rows.select("o_orderkey", extraction.due_text(said).alias("due"))


def short_times(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", times.short(at, F.lit(1705329000)).alias("short"), times.iso_millis(at).alias("iso"), times.plain(at).alias("plain"))


def tenants(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("id") % 2 == 0, F.concat(F.lit("0000ABCD-0000-0000-0000-"), F.lpad(F.col("id").cast("string"), 12, "0"))).when(F.col("id") % 3 == 0, "broken")
    return R.people(spark, d).select("id", times.tenant_or_nil(said).alias("tenant"))


def loudness(spark: SparkSession, d: str) -> DataFrame:
    samples = F.transform("embedding", lambda x: x.cast("double") * (F.col("id") % 9) / 2)
    level = signal.rms(samples)
    seconds = (F.col("id") % 40).cast("double")
    score = signal.quality(level, seconds)
    rows = R.voices(spark, d)
    return rows.select("id", F.round(level, 6).alias("rms"), F.round(score, 6).alias("score"), signal.rejection(seconds, F.round(score, 6)).alias("reason"), signal.retained(F.when(F.col("id") % 2 == 0, F.col("speaker_id")), F.round(score, 6)).alias("retained"))


def enrolment(spark: SparkSession, d: str) -> DataFrame:
    rows = R.voices(spark, d).select("speaker_id", F.col("id").alias("at"), (F.col("id") % 40).cast("double").alias("seconds"), ((F.col("id") % 11) / 10).alias("score"))
    return signal.enrolled(rows).select("at", "reason", "place", "is_primary")


def mono_half_rate(spark: SparkSession, d: str) -> DataFrame:
    mono = signal.folded(F.col("embedding"), 2)
    half = signal.resampled(mono, 32_000, 20_000)
    return R.voices(spark, d).select("id", F.size(mono).alias("n_mono"), F.size(half).alias("n_half"), F.round(mono[3], 6).alias("mono_3"), F.round(half[7], 6).alias("half_7"), F.round(F.aggregate(half, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def target_language(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("漢字"), F.col("n_chars").cast("int")))).when(F.col("doc_id") % 3 == 1, F.concat(F.left("text", F.lit(9)), F.lit("ひらがなカタカナ漢字ひらがなカタカナ漢字ひらがな"))).otherwise(F.col("text"))
    langs = ("en", "zh", "ja")
    return rows.select("doc_id", times.once(text.letters(said), lambda n: F.struct(*[text.written_as(n, lang).alias(lang) for lang in langs])).alias("fits")).select("doc_id", "fits.*")


QUERIES = {
    f.__name__: f
    for f in (
        open_sessions, session_list, end_sessions, active_live_windows, unknown_in_session, unknown_everywhere, retained_candidates, segments_by_ids, missing_ids, clip_archive, clip_members, clip_merge,
        speaker_list, provisional_list, provisional_sweep, promote_speakers, touch_speakers, mark_self, dismiss_segments, assign_segments, upsert_segments, replace_vectors, rollback_vectors, label_list,
        labels_per_tenant, seed_labels, matching_labels, replace_label_links, requeue_stale, needs_review, reminder_archive, board_with_label, tray, session_reminders, add_finals, tagged_lines, longest_members,
        clip_gate, candidate_pools, pending_batch, changed_speakers, process_windows, window_states, normalised_items, due_formats, short_times, tenants, loudness, enrolment, mono_half_rate, target_language,
    )
}

_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_OVERLAPS = "first_met AS (SELECT t.id AS line_id, arg_min(s.speaker_id, (s.start_ms, s.id)) AS speaker_id FROM transcripts t JOIN segments s ON s.session_id = t.session_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms WHERE t.segment_id IS NULL GROUP BY t.id)"
_LINES = """lines AS (SELECT t.session_id, t.id, t.start_ms, t.end_ms, t.text, coalesce(g.speaker_id, o.speaker_id) AS speaker_id, coalesce(p.display_name, 'Unknown') AS speaker_name FROM transcripts t
    LEFT JOIN segments g ON g.id = t.segment_id LEFT JOIN first_met o ON o.line_id = t.id LEFT JOIN speakers p ON p.id = coalesce(g.speaker_id, o.speaker_id) WHERE t.is_final)"""
_LATEST = "latest AS (SELECT session_id, max(end_ms) FILTER (WHERE is_final) AS m FROM transcripts GROUP BY session_id)"
_INSIDE = """windows AS (SELECT session_id, unnest(generate_series(0, m - 1, 45000)) AS window_start FROM latest WHERE m > 0),
    met AS (SELECT w.session_id, w.window_start, l.* EXCLUDE (session_id), sum(strlen(l.text)) OVER (PARTITION BY w.session_id, w.window_start) AS n_bytes
        FROM windows w JOIN lines l ON l.session_id = w.session_id AND l.start_ms < w.window_start + 60000 AND l.end_ms > w.window_start), inside AS (SELECT * FROM met WHERE n_bytes >= 60)"""
_ITEMS = """SELECT *, session_id || '-' || window_start || '-' || id AS item_id, nullif(CASE WHEN length(text) % 3 <> 0 THEN trim(' About ' || left(text, 10)) END, '') AS title,
    CASE length(text) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS word, CASE WHEN length(text) % 2 = 0 THEN '2024-03-05T14:30' END AS due_time,
    CASE WHEN length(text) % 5 <> 0 THEN trim(lower(left(text, 24))) END AS quote"""

ORACLE_SQL = {
    "open_sessions": with_sql("sessions", "SELECT tenant_id, arg_min(id, (-started_s, id)) AS session_id FROM sessions WHERE mode = 'always_on' AND ended_s IS NULL GROUP BY tenant_id"),
    "session_list": with_sql("sessions", "SELECT id, mode, started_s FROM sessions WHERE tenant_id = 'src1' ORDER BY started_s DESC, id LIMIT 100"),
    "end_sessions": with_sql("sessions", "SELECT id, CASE WHEN mode = 'always_on' THEN 1000000000 ELSE ended_s END AS ended_s FROM sessions"),
    "active_live_windows": with_sql("transcripts sessions", f", {_LATEST} SELECT session_id, s AS start_ms, s + 60000 AS end_ms FROM (SELECT session_id, unnest(generate_series(0, m - 75000, 45000)) AS s FROM latest WHERE m - 15000 >= 60000 AND session_id IN (SELECT id FROM sessions WHERE ended_s IS NULL))"),
    "unknown_in_session": with_sql("clip_segments", "SELECT id, start_ms FROM clip_segments WHERE speaker_id IS NULL AND session_id = 7 ORDER BY start_ms, id LIMIT 20"),
    "unknown_everywhere": with_sql("clip_segments", "SELECT id, session_id, start_ms FROM clip_segments WHERE speaker_id IS NULL ORDER BY start_ms DESC, id LIMIT 100"),
    "retained_candidates": with_sql("clip_segments", "SELECT id, session_id, audio_ref FROM clip_segments WHERE speaker_id IS NULL AND audio_ref IS NOT NULL AND has_vector AND dismissed_s IS NULL ORDER BY start_ms DESC, id LIMIT 50"),
    "segments_by_ids": with_sql("clip_segments", "SELECT id, clip_id FROM clip_segments WHERE id < 4000 AND id % 9 = 0"),
    "missing_ids": "SELECT DISTINCT c_custkey * 7 AS id FROM customer WHERE c_custkey * 7 NOT IN (SELECT c_custkey FROM customer)",
    "clip_archive": with_sql("clips", "SELECT id, status, ended_at_ms - started_at_ms AS duration_ms, segment_count FROM clips WHERE status IN ('processed', 'empty') ORDER BY started_at_ms DESC, id LIMIT 500"),
    "clip_members": with_sql("clip_segments", "SELECT id, start_ms, end_ms FROM clip_segments WHERE clip_id = '7-3' ORDER BY start_ms, id"),
    "clip_merge": with_sql("clips", """SELECT id, CASE WHEN session_id % 2 = 0 THEN status ELSE 'old' END AS text, session_id % 3 <> 0 AND segment_count % 2 = 0 AS starred
        FROM clips WHERE session_id % 3 <> 0 OR session_id % 2 = 0"""),
    "speaker_list": with_sql("people", "SELECT id, display_name FROM people WHERE tenant_id = 'src2' AND status = 'active' ORDER BY display_name, id"),
    "provisional_list": with_sql("people", "SELECT id, tenant_id, last_matched_s FROM people WHERE kind = 'provisional' AND status = 'active'"),
    "provisional_sweep": with_sql("people", "SELECT id, kind FROM people WHERE NOT (kind = 'provisional' AND (last_matched_s IS NULL OR last_matched_s < 3000000 - 2592000))"),
    "promote_speakers": with_sql("people", """SELECT id, CASE WHEN kind = 'provisional' AND id % 4 = 0 THEN 'Named ' || id ELSE display_name END AS display_name,
        CASE WHEN id % 2 = 0 THEN 'enrolled' ELSE kind END AS kind, CASE WHEN NOT (kind = 'provisional' AND id % 2 = 0) THEN last_matched_s END AS last_matched_s FROM people"""),
    "touch_speakers": with_sql("people", "SELECT id, CASE WHEN kind = 'provisional' AND id % 5 = 0 THEN 1000000000 ELSE last_matched_s END AS last_matched_s FROM people"),
    "mark_self": with_sql("people", "SELECT id, CASE WHEN tenant_id = 'src3' THEN id = 8 ELSE is_self END AS is_self FROM people"),
    "dismiss_segments": with_sql("clip_segments", "SELECT id, CASE WHEN id % 10 <> 1 THEN audio_ref END AS audio_ref, CASE WHEN id % 10 = 1 THEN 1000000000 ELSE dismissed_s END AS dismissed_s FROM clip_segments"),
    "assign_segments": with_sql("clip_segments", """SELECT id, CASE WHEN id % 12 = 0 THEN 'someone' WHEN id % 6 <> 0 THEN speaker_id END AS speaker_id, CASE WHEN id % 12 <> 0 THEN audio_ref END AS audio_ref FROM clip_segments"""),
    "upsert_segments": with_sql("clip_segments", """SELECT id, session_id, CASE WHEN id % 3 <> 1 THEN 'new' ELSE clip_id END AS clip_id, CASE WHEN id % 2 = 0 THEN start_ms ELSE start_ms + 1 END AS start_ms, end_ms
        FROM clip_segments WHERE id % 2 = 0 OR id % 3 <> 1"""),
    "replace_vectors": with_sql("voices", """, new AS (SELECT id + 100000 AS id, speaker_id FROM voices WHERE speaker_id % 2 = 0 AND id % 3 = 0)
        SELECT id, speaker_id FROM voices WHERE speaker_id NOT IN (SELECT speaker_id FROM new) UNION ALL SELECT * FROM new"""),
    "rollback_vectors": with_sql("voices", "SELECT id, speaker_id FROM voices WHERE id % 4 <> 1"),
    "label_list": with_sql("named_labels", "SELECT id, name FROM named_labels WHERE tenant_id = 'src2' ORDER BY name"),
    "labels_per_tenant": with_sql("named_labels", "SELECT tenant_id, count(*) AS n_labels FROM named_labels GROUP BY tenant_id"),
    "seed_labels": with_sql("named_labels sessions", """, kept AS (SELECT tenant_id, name, '#111111' AS color, '#eeeeee' AS bg_color FROM named_labels WHERE tenant_id <> 'src1'),
        first(name, color, bg_color) AS (VALUES ('Work', '#1d4ed8', '#dbeafe'), ('Personal', '#6d28d9', '#ede9fe'), ('Urgent', '#b91c1c', '#fee2e2'), ('Idea', '#a16207', '#fef3c7'), ('Follow-up', '#15803d', '#dcfce7'), ('Meeting', '#0e7490', '#cffafe'))
        SELECT * FROM kept UNION ALL SELECT tenant_id, first.* FROM (SELECT DISTINCT tenant_id FROM sessions WHERE tenant_id NOT IN (SELECT tenant_id FROM kept)), first"""),
    "matching_labels": with_sql("people named_labels", """, l AS (SELECT max(CASE WHEN lower(name) = 'france' THEN CAST(id AS VARCHAR) END) AS f, max(CASE WHEN lower(name) = 'peru' THEN CAST(id AS VARCHAR) END) AS p, max(CASE WHEN lower(name) = 'china' THEN CAST(id AS VARCHAR) END) AS c FROM named_labels)
        SELECT id, array_to_string(list_sort(list_filter([c, CASE id % 3 WHEN 0 THEN f WHEN 1 THEN p END], lambda x: x IS NOT NULL)), ',') AS label_ids FROM people, l"""),
    "replace_label_links": with_sql("reminders reminder_labels", """SELECT * FROM reminder_labels WHERE reminder_id % 5 <> 0
        UNION ALL SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END) FROM reminders WHERE id % 5 = 0"""),
    "requeue_stale": with_sql("clips", "SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM clips"),
    "needs_review": with_sql("reminders", "SELECT tenant_id, count(*) AS n_pending FROM reminders WHERE status = 'pending' GROUP BY tenant_id"),
    "reminder_archive": with_sql("reminders", "SELECT id, tenant_id, created_s FROM reminders WHERE status = 'archived'"),
    "board_with_label": with_sql("reminders", "SELECT r.id, status FROM reminders r JOIN labels l ON l.doc_id = r.id AND l.quality = 1 WHERE tenant_id = 'src1' AND status NOT IN ('archived', 'pending') AND priority = 'high'"),
    "tray": with_sql("reminders", f"SELECT id, priority FROM reminders WHERE tenant_id = 'src2' AND status NOT IN ('archived', 'pending') ORDER BY {_RANK}, created_s DESC, id LIMIT 6"),
    "session_reminders": with_sql("reminders", "SELECT id, title, status FROM reminders WHERE session_id = 11"),
    "add_finals": with_sql("transcripts segments", "SELECT t.id, s.id AS segment_id, t.text FROM transcripts t LEFT JOIN (SELECT * FROM segments WHERE session_id % 2 = 0) s ON s.id = t.segment_id"),
    "tagged_lines": with_sql("transcripts segments speakers", "SELECT t.id, '[' || coalesce(p.display_name, 'UNKNOWN') || '] ' || t.text AS text FROM transcripts t LEFT JOIN segments s ON s.id = t.segment_id LEFT JOIN speakers p ON p.id = s.speaker_id"),
    "longest_members": with_sql("clip_segments", "SELECT clip_id AS cluster, id, row_number() OVER (PARTITION BY clip_id ORDER BY end_ms - start_ms DESC, id) AS place, place = 1 AS is_primary FROM clip_segments QUALIFY place <= 3"),
    "clip_gate": with_sql("clip_segments", "SELECT clip_id, speaker_id AS cluster, count(*) AS n_rows, sum(end_ms - start_ms) AS total_ms FROM clip_segments GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(end_ms - start_ms) >= 8000"),
    "candidate_pools": with_sql("voices people", "SELECT v.id, p.id AS person_id, p.kind FROM voices v JOIN people p ON p.id = v.id % 150 WHERE p.tenant_id = 'src1' AND p.status = 'active' AND len(v.embedding) = 64"),
    "pending_batch": with_sql("transcripts", "SELECT session_id, id FROM transcripts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY start_ms, id) <= 4"),
    "changed_speakers": with_sql("clip_segments", "SELECT id, speaker_id FROM clip_segments WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, id) QUALIFY row_number() OVER w = 1 OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER w"),
    "process_windows": with_sql("transcripts segments speakers sessions", f""", {_OVERLAPS}, {_LINES}, {_LATEST}, {_INSIDE},
        items AS ({_ITEMS} FROM inside WHERE length(text) > 200), good AS (SELECT * FROM items WHERE word IN ('high', 'medium') AND quote IS NOT NULL AND trim(text) <> ''),
        origin AS (SELECT g.item_id, arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS speaker, min(l.start_ms) FILTER (WHERE contains(lower(l.text), lower(g.quote))) AS ms,
            arg_min(l.speaker_id, (l.start_ms, l.id)) FILTER (WHERE lower(l.speaker_name) = lower(g.speaker_name) AND lower(g.speaker_name) <> 'unknown') AS named
            FROM good g JOIN inside l ON l.session_id = g.session_id AND l.window_start = g.window_start GROUP BY g.item_id)
        SELECT g.item_id AS id, g.session_id, g.window_start, g.title, g.word AS priority, CASE g.word WHEN 'high' THEN 'open' ELSE 'pending' END AS status, coalesce(o.speaker, o.named) AS speaker_id,
            s.started_s * 1000 + coalesce(o.ms, g.window_start) AS source_ms, g.quote AS excerpt, CASE WHEN g.due_time IS NOT NULL THEN '2024-03-05 19:30:00' END AS due, coalesce(p.id, '') AS label_ids
        FROM good g JOIN origin o ON o.item_id = g.item_id LEFT JOIN sessions s ON s.id = g.session_id LEFT JOIN speakers p ON lower(p.display_name) = lower(g.speaker_name)
        WHERE NOT EXISTS (SELECT 1 FROM transcripts t WHERE t.session_id % 10 = 0 AND t.session_id = g.session_id AND t.text = trim(g.text))
        QUALIFY row_number() OVER (PARTITION BY g.session_id, trim(g.text) ORDER BY g.item_id) = 1"""),
    "window_states": with_sql("transcripts segments speakers", f", {_OVERLAPS}, {_LINES}, {_LATEST}, {_INSIDE} SELECT w.session_id, w.window_start AS start_ms, CASE WHEN EXISTS (SELECT 1 FROM inside i WHERE i.session_id = w.session_id AND i.window_start = w.window_start) THEN 'succeeded' ELSE 'empty' END AS status FROM windows w"),
    "normalised_items": with_sql("transcripts", f""", rows AS (SELECT session_id, 0 AS window_start, id, text FROM transcripts WHERE length(text) > 200)
        SELECT item_id, title, word AS priority, due_time, 'BOB' AS labels, word AS confidence, quote AS evidence_quote, 'Bob' AS speaker_name FROM ({_ITEMS} FROM rows)"""),
    "due_formats": """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT09:00') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT09:00')
        WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%dT09:00') WHEN 7 THEN strftime(o_orderdate, '%Y-%-m-%-dT09:00') WHEN 8 THEN strftime(o_orderdate, '%-m/%-d/%Y') || ' 9:05' END AS due FROM orders""",
    "short_times": """, t AS (SELECT event_id, date_trunc('second', ts) AS t0, epoch_us(ts) // 1000000 AS s FROM events), u AS (SELECT *, CAST(floor((s - 1705329000) / 60.0 + 0.5) AS BIGINT) AS m, date_diff('day', DATE '2024-01-15', CAST(t0 AS DATE)) AS days, strftime(t0, '%-I:%M %p') AS clock, strftime(t0, '%A') AS weekday, strftime(t0, '%b %-d') AS day FROM t)
        SELECT event_id, CASE WHEN m < 0 THEN CASE WHEN days = 0 THEN clock WHEN days >= -6 THEN 'Due ' || weekday ELSE 'Due ' || day END WHEN m < 60 THEN 'In ' || m || ' min' WHEN days = 0 THEN clock || ' today'
            WHEN days = 1 THEN 'Tomorrow at ' || clock WHEN days <= 6 THEN weekday || ' at ' || clock ELSE day END AS short, strftime(t0, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(t0, '%Y-%m-%d %H:%M:%S') AS plain FROM u""".replace(", t AS", "WITH t AS", 1),
    "tenants": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '0000abcd-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') ELSE '00000000-0000-0000-0000-000000000000' END AS tenant FROM customer",
    "loudness": with_sql("voices", """, r AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) * (id % 9) / 2) * (CAST(x AS DOUBLE) * (id % 9) / 2))) / len(embedding)) AS l, CAST(id % 40 AS DOUBLE) AS sec FROM voices),
        t AS (SELECT *, CASE WHEN l < 0.01 THEN 0 WHEN l < 0.05 THEN (l - 0.01) / (0.05 - 0.01) WHEN l <= 0.3 THEN 1 WHEN l <= 0.6 THEN 1 - (l - 0.3) / (0.6 - 0.3) ELSE 0 END AS loud, CASE WHEN sec < 3 THEN 0 WHEN sec >= 8 THEN 1 ELSE (sec - 3) / 5 END AS long FROM r),
        q AS (SELECT *, CAST(round(CASE WHEN loud = 0 THEN 0.0 ELSE 0.7 * loud + 0.3 * long END, 6) AS DOUBLE) AS score FROM t)
        SELECT id, round(l, 6) AS rms, score, CASE WHEN sec < 3 THEN 'too_short' WHEN sec > 30 THEN 'too_long' WHEN score < 0.6 THEN 'low_quality' END AS reason, id % 2 <> 0 AND score >= 0.6 AS retained FROM q"""),
    "enrolment": with_sql("voices", """, c AS (SELECT speaker_id, id AS "at", CASE WHEN id % 40 < 3 THEN 'too_short' WHEN id % 40 > 30 THEN 'too_long' WHEN id % 11 < 6 THEN 'low_quality' END AS reason FROM voices),
        p AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY speaker_id, reason IS NULL ORDER BY "at") END AS n FROM c)
        SELECT "at", reason, CASE WHEN n <= 3 THEN CAST(n AS INTEGER) END AS place, coalesce(n = 1, false) AS is_primary FROM p"""),
    "mono_half_rate": with_sql("voices", """, m AS (SELECT id, list_transform(range(0, len(embedding) // 2), lambda k: (CAST(embedding[2 * k + 1] AS DOUBLE) + CAST(embedding[2 * k + 2] AS DOUBLE)) / 2) AS mono FROM voices),
        h AS (SELECT *, list_transform(range(0, len(mono) * 20000 // 32000), lambda k: mono[CAST(floor(k * 1.6) AS BIGINT) + 1] + (coalesce(mono[CAST(floor(k * 1.6) AS BIGINT) + 2], mono[CAST(floor(k * 1.6) AS BIGINT) + 1]) - mono[CAST(floor(k * 1.6) AS BIGINT) + 1]) * (k * 1.6 - floor(k * 1.6))) AS half FROM m)
        SELECT id, CAST(len(mono) AS INTEGER) AS n_mono, CAST(len(half) AS INTEGER) AS n_half, round(mono[4], 6) AS mono_3, round(half[8], 6) AS half_7, round(list_sum(half), 4) AS total FROM h"""),
    "target_language": """WITH said AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || repeat('漢字', n_chars) WHEN 1 THEN left(text, 9) || 'ひらがなカタカナ漢字ひらがなカタカナ漢字ひらがな' ELSE text END AS t FROM documents),
        n AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin, length(regexp_replace(t, '[^一-鿿㐀-䶿]', '', 'g')) AS cjk, length(regexp_replace(t, '[^぀-ヿ]', '', 'g')) AS kana FROM said)
        SELECT doc_id, latin + cjk + kana >= 3 AND latin >= 0.7 * (latin + cjk + kana) AS en, latin + cjk + kana >= 3 AND cjk >= 0.7 * (latin + cjk + kana) AND kana = 0 AS zh, latin + cjk + kana >= 3 AND kana > 0 AND kana + cjk >= 0.7 * (latin + cjk + kana) AS ja FROM n""",
}
