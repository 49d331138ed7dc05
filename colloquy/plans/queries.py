"""The registered queries over the generated tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.functions import text
from colloquy.operators import clustering, intervals, neighbours, relational, state, vectors
from colloquy.sources import relations as R
from colloquy.sources.relations import with_sql
from colloquy.streaming import folds

#: The generated conversations are short, so windows are, too.
SHORT = Settings(window_ms=60_000, window_step_ms=45_000, late_margin_ms=15_000)
#: Users' events are hours apart.
LONG = Settings(continuity_ms=6 * 3_600_000, clip_target_ms=12 * 3_600_000, clip_max_ms=24 * 3_600_000, silence_close_ms=3_600_000)
NOW_S = 10**9


def window_prompts(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d)
    windows = intervals.final_windows(relational.latest_final(lines), SHORT)
    return intervals.window_prompts(windows, intervals.attributed_lines(lines, R.segments(spark, d), R.speakers(spark, d)), SHORT)


def live_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.live_windows(relational.latest_final(R.transcripts(spark, d)), SHORT)


def final_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.final_windows(relational.latest_final(R.transcripts(spark, d)), SHORT)


def reminder_list(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.list_reminders(R.reminders(spark, d), R.reminder_labels(spark, d), "src3", status="open", label="quality", limit=20)
    return rows.select("id", "title", "status", "priority", "created_s")


def reminder_search(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.list_reminders(R.reminders(spark, d), R.reminder_labels(spark, d), "src0", search="THE%of_", limit=200)
    return rows.select("id", "session_id", "status")


def reminders_with_labels(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_label_ids(R.reminders(spark, d), R.reminder_labels(spark, d)).select("id", F.array_join("label_ids", ",").alias("label_ids"))


def label_usage(spark: SparkSession, d: str) -> DataFrame:
    return relational.label_usage(R.reminder_labels(spark, d))


def trace_resolution(spark: SparkSession, d: str) -> DataFrame:
    return relational.trace_sources(R.reminders(spark, d), R.segments(spark, d), R.transcripts(spark, d).where("segment_id IS NULL"))


def attributed_lines(spark: SparkSession, d: str) -> DataFrame:
    return intervals.attributed_lines(R.transcripts(spark, d), R.segments(spark, d), R.speakers(spark, d))


def midpoint_attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = R.user_segments(spark, d)
    return intervals.midpoint_speakers(rows, rows)


def clip_archive_text(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d)
    return relational.clip_texts(lines.select(F.col("session_id").alias("id")).distinct(), lines)


def kind_runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.runs(R.user_segments(spark, d), "session_id", ["start_ms", "id"], ["kind"])


def _near(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    pool = R.voices(spark, d)
    return vectors.nearest(pool.where("id % 50 = 0"), pool, k)


def knn(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("query", "id", "speaker_id", F.round("sim", 4).alias("sim"), "place")


def near_voices(spark: SparkSession, d: str) -> DataFrame:
    pool = R.voices(spark, d)
    return neighbours.nearest(pool.where("id % 50 = 0"), pool, 5, per_block=256).select("query", "id", "speaker_id", F.round("sim", 4).alias("sim"), "place")


def knn_znorm(spark: SparkSession, d: str) -> DataFrame:
    return vectors.accepted_by_score(_near(spark, d)).select("query", "id", "speaker_id", F.round("z", 4).alias("z"), "accepted")


def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return vectors.accepted_by_threshold(_near(spark, d), 0.45, 0.38).select("query", "id", "speaker_id", "level")


def centroid_match(spark: SparkSession, d: str) -> DataFrame:
    pool = R.voices(spark, d)
    return vectors.match_centroid(pool.where("id % 50 = 0"), vectors.centroids(pool), 0.2)


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cluster_stats(R.user_segments(spark, d).withColumn("cluster", F.concat_ws("-", "kind", F.col("session_id") % 20)))


def ahc_clusters(spark: SparkSession, d: str) -> DataFrame:
    clip = F.concat_ws("-", "speaker_id", F.floor(F.col("id") / 1000).cast("string"))
    return clustering.cluster_clips(R.voices(spark, d).withColumn("clip_id", clip), distance=0.75)


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster_candidates(R.voices(spark, d).withColumn("start_ms", F.col("id") * 1000), "speaker_id", 0.2)


def continuity_attribution(spark: SparkSession, d: str) -> DataFrame:
    return folds.attribute_continuity(continuity_events(R.user_segments(spark, d)), LONG)


def continuity_events(rows: DataFrame) -> DataFrame:
    size = F.abs("value") % 3
    evidence = F.when(size < 1, "confirmed").when(size < 2, "tentative").otherwise("unknown")
    return rows.select("session_id", "id", "end_ms", evidence.alias("evidence"), F.when(evidence != "unknown", F.col("kind")).alias("speaker_id"))


def clip_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return folds.close_clips(R.user_segments(spark, d).withColumn("kind", F.lit("speech")), LONG)


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    rows = R.reminders(spark, d)
    return state.insert_new(rows.where("status = 'open'"), rows.where("status <> 'open'")).select("id", "session_id", "status")


def window_upsert(spark: SparkSession, d: str) -> DataFrame:
    latest = relational.latest_final(R.transcripts(spark, d))
    status = F.when(F.col("session_id") % 2 == 0, "pending").otherwise("running")
    old = intervals.final_windows(latest, SHORT).where("start_ms < 60000").withColumn("status", status).withColumn("attempts", F.lit(1))
    return state.upsert_windows(old, intervals.final_windows(latest, Settings(window_ms=90_000, window_step_ms=45_000)))


def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("priority") == "high", "archived").when(F.col("priority") == "low", "open").otherwise(F.col("status"))
    at = F.when(F.col("status") == "archived", F.col("created_s"))
    rows = R.reminders(spark, d).withColumn("new_status", new)
    return rows.select("id", "new_status", state.archived_at(F.col("status"), F.col("new_status"), at, F.lit(NOW_S)).alias("archived_at"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).select("id", "tenant_id", "created_s", F.when(F.col("status") == "pending", "pending").when(F.col("status") == "open", "running").otherwise("succeeded").alias("status"), (F.col("id") % 5).cast("int").alias("attempts"))


def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return state.claim_next(_queue(spark, d), "tenant_id", ["created_s", "id"], 3).select("id", "status", "attempts")


def queue_finish(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 3 == 1, "retry").otherwise("succeeded")
    return state.finish(_queue(spark, d), outcome).select("id", "status", "attempts")


def priority_board(spark: SparkSession, d: str) -> DataFrame:
    return relational.board(R.reminders(spark, d), "src1", "er").select("id", "status", "priority")


def prune_unstarred(spark: SparkSession, d: str) -> DataFrame:
    rows = R.reminders(spark, d).withColumn("starred", F.col("status") == "completed")
    return relational.newest_unstarred(rows, 30, "tenant_id", [F.desc("created_s"), F.asc("id")]).select("id", "tenant_id", "starred")


def evidence_match(spark: SparkSession, d: str) -> DataFrame:
    lines = R.transcripts(spark, d)
    items = lines.select(F.col("id").alias("item_id"), "session_id", F.element_at(F.split("text", " "), 1).alias("quote"))
    return text.first_quoted_line(items, lines)


def script_share(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", F.round(text.script_share(F.col("text"), "IsLatin"), 6).alias("latin"), text.meaningful(F.col("text")).alias("meaningful"))


def reminder_titles(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).select("id", text.title_or_text(F.col("title"), F.col("description")).alias("title"), F.coalesce("priority", F.lit("medium")).alias("priority"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return R.reminders(spark, d).select("id", text.excerpt(F.col("description")).alias("excerpt"))


def patch_reminders(spark: SparkSession, d: str) -> DataFrame:
    rows = R.reminders(spark, d)
    changes = rows.select("id", F.when(F.col("id") % 2 == 0, "high").alias("priority"), F.when(F.col("id") % 3 == 0, "New").alias("title"))
    return state.patch(rows, changes, ("priority", "title")).select("id", "priority", "title", "status")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = R.reminders(spark, d).where("status = 'archived'").select("id")
    return state.without(R.reminder_labels(spark, d), gone, "reminder_id")


def unlink_speakers(spark: SparkSession, d: str) -> DataFrame:
    gone = R.speakers(spark, d).where("id = 'user'").select("id")
    return state.unlink(R.segments(spark, d), gone, "speaker_id").select("id", "session_id", "speaker_id")


def json_recovery(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    answer = F.concat(F.lit("<think>so</think>Sure:\n```json\n{\"items\": ["), "props", F.lit("]}\n```"))
    return rows.select("event_id", F.array_join(text.recovered(answer), ";").alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        window_prompts, live_windows, final_windows, reminder_list, reminder_search, reminders_with_labels, label_usage, trace_resolution, attributed_lines,
        midpoint_attribution, clip_archive_text, kind_runs, knn, near_voices, knn_znorm, knn_threshold, centroid_match, cluster_stats, ahc_clusters, leader_clusters,
        continuity_attribution, clip_boundaries, insert_new, window_upsert, status_transitions, queue_claim, queue_finish, priority_board, prune_unstarred,
        evidence_match, script_share, reminder_titles, excerpts, patch_reminders, cascade_delete, unlink_speakers, json_recovery,
    )
}

_LINES = "lines AS (SELECT t.session_id, t.id, t.start_ms, t.end_ms, t.text, coalesce(g.speaker_id, o.speaker_id) AS speaker_id FROM transcripts t LEFT JOIN segments g ON g.id = t.segment_id LEFT JOIN first_met o ON o.line_id = t.id WHERE t.is_final)"
_OVERLAPS = "first_met AS (SELECT t.id AS line_id, arg_min(s.speaker_id, (s.start_ms, s.id)) AS speaker_id FROM transcripts t JOIN segments s ON s.session_id = t.session_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms WHERE t.segment_id IS NULL GROUP BY t.id)"
_LATEST = "latest AS (SELECT session_id, max(end_ms) FILTER (WHERE is_final) AS m FROM transcripts GROUP BY session_id)"
_WINDOWS = "windows AS (SELECT session_id, unnest(generate_series(0, m - 1, 45000)) AS start_ms FROM latest WHERE m > 0)"
_NEAR = """near AS (SELECT query, id, speaker_id, sim, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS place
    FROM (SELECT q.id AS query, p.id, p.speaker_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS sim FROM voices q JOIN voices p ON q.id <> p.id WHERE q.id % 50 = 0) QUALIFY place <= 5)"""
_QUEUE = "queue AS (SELECT id, tenant_id, created_s, CASE status WHEN 'pending' THEN 'pending' WHEN 'open' THEN 'running' ELSE 'succeeded' END AS status, id % 5 AS attempts FROM reminders)"


def _clock(ms: str) -> str:
    return f"printf('%02d:%02d:%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60)"


ORACLE_SQL = {
    "window_prompts": with_sql("transcripts segments speakers", f""", {_OVERLAPS}, {_LINES}, {_LATEST}, {_WINDOWS}
        SELECT w.session_id, w.start_ms AS window_start, sum(strlen(l.text)) AS n_bytes,
            string_agg('[' || {_clock("l.start_ms")} || ' • ' || coalesce(s.display_name, 'Unknown') || ']: ' || l.text, chr(10) ORDER BY l.start_ms, l.id) AS prompt
        FROM windows w JOIN lines l ON l.session_id = w.session_id AND l.start_ms < w.start_ms + 60000 AND l.end_ms > w.start_ms LEFT JOIN speakers s ON s.id = l.speaker_id
        GROUP BY 1, 2 HAVING sum(strlen(l.text)) >= 60"""),
    "live_windows": with_sql("transcripts", f", {_LATEST} SELECT session_id, s AS start_ms, s + 60000 AS end_ms FROM (SELECT session_id, unnest(generate_series(0, m - 75000, 45000)) AS s FROM latest WHERE m - 15000 >= 60000)"),
    "final_windows": with_sql("transcripts", f", {_LATEST}, {_WINDOWS} SELECT session_id, start_ms, start_ms + 60000 AS end_ms FROM windows"),
    "reminder_list": with_sql("reminders reminder_labels", """SELECT id, title, status, priority, created_s FROM reminders r WHERE tenant_id = 'src3' AND status = 'open'
        AND EXISTS (SELECT 1 FROM reminder_labels b WHERE b.reminder_id = r.id AND b.label_id = 'quality') ORDER BY created_s DESC, id LIMIT 20"""),
    "reminder_search": with_sql("reminders", """SELECT id, session_id, status FROM reminders WHERE tenant_id = 'src0'
        AND (coalesce(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%of_%', false) OR translate(description, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%of_%')
        ORDER BY created_s DESC, id LIMIT 200"""),
    "reminders_with_labels": with_sql("reminders reminder_labels", "SELECT r.id, coalesce(string_agg(DISTINCT b.label_id, ',' ORDER BY b.label_id), '') AS label_ids FROM reminders r LEFT JOIN reminder_labels b ON b.reminder_id = r.id GROUP BY r.id"),
    "label_usage": with_sql("reminder_labels", "SELECT label_id, count(*) AS n_reminders FROM reminder_labels GROUP BY label_id"),
    "trace_resolution": with_sql("reminders segments transcripts", """SELECT r.id, r.source_window_id, CASE WHEN c.id IS NOT NULL THEN 'clip' WHEN w.id IS NOT NULL THEN 'window' ELSE 'none' END AS source_kind,
        coalesce(c.session_id, w.session_id) AS source_session, coalesce(c.start_ms, w.start_ms) AS source_start_ms
        FROM reminders r LEFT JOIN segments c ON c.id = r.source_window_id LEFT JOIN (SELECT * FROM transcripts WHERE segment_id IS NULL) w ON w.id = r.source_window_id"""),
    "attributed_lines": with_sql("transcripts segments speakers", f", {_OVERLAPS}, {_LINES} SELECT l.*, coalesce(s.display_name, 'Unknown') AS speaker_name FROM lines l LEFT JOIN speakers s ON s.id = l.speaker_id"),
    "midpoint_attribution": with_sql("user_segments", """SELECT l.id, arg_min(e.id, (e.start_ms, e.id)) AS event_id, arg_min(e.kind, (e.start_ms, e.id)) AS kind FROM user_segments l
        LEFT JOIN user_segments e ON e.session_id = l.session_id AND (l.start_ms + l.end_ms) / 2.0 BETWEEN e.start_ms AND e.end_ms GROUP BY l.id"""),
    "clip_archive_text": with_sql("transcripts", "SELECT session_id AS id, string_agg(text, ' ' ORDER BY start_ms, id) FILTER (WHERE is_final) AS text FROM transcripts GROUP BY session_id"),
    "kind_runs": with_sql("user_segments", """, marked AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM user_segments WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, id)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start_ms, id) AS run FROM marked)
        SELECT session_id, run, kind, count(*) AS n_rows, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY session_id, run, kind"""),
    "knn": with_sql("voices", f", {_NEAR} SELECT query, id, speaker_id, round(sim, 4) AS sim, place FROM near"),
    "near_voices": with_sql("voices", f", {_NEAR} SELECT query, id, speaker_id, round(sim, 4) AS sim, place FROM near"),
    "knn_znorm": with_sql("voices", f""", {_NEAR}, s AS (SELECT *, avg(sim) OVER (PARTITION BY query) AS m, stddev_pop(sim) OVER (PARTITION BY query) AS d, count(*) OVER (PARTITION BY query) AS n FROM near)
        SELECT query, id, speaker_id, CASE WHEN d <= 0.001 THEN 0.0 ELSE round((sim - m) / d, 4) END AS z, CASE WHEN d <= 0.001 THEN sim >= 0.5 ELSE sim > m END AS accepted
        FROM s WHERE (d <= 0.001 AND place = n) OR (d > 0.001 AND place = 1)"""),
    "knn_threshold": with_sql("voices", f", {_NEAR} SELECT query, id, CASE WHEN sim >= 0.38 THEN speaker_id END AS speaker_id, CASE WHEN sim >= 0.45 THEN 'confirmed' WHEN sim >= 0.38 THEN 'tentative' ELSE 'none' END AS level FROM near WHERE place = 1"),
    "centroid_match": with_sql("voices", """, flat AS (SELECT speaker_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM voices),
        means AS (SELECT speaker_id, pos, avg(x) AS x FROM flat GROUP BY 1, 2), centers AS (SELECT speaker_id, list(x ORDER BY pos) AS c FROM means GROUP BY 1),
        sims AS (SELECT q.id, c.speaker_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), c.c), 9) AS sim FROM voices q JOIN centers c ON len(q.embedding) = len(c.c) WHERE q.id % 50 = 0),
        best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, speaker_id) = 1)
        SELECT id, CASE WHEN sim >= 0.2 THEN speaker_id END AS speaker_id, round(sim, 6) AS sim FROM best"""),
    "cluster_stats": with_sql("user_segments", """SELECT kind || '-' || session_id % 20 AS cluster, count(*) AS n_rows, sum(end_ms - start_ms) AS total_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms,
        count(DISTINCT session_id) AS n_sessions, arg_min(id, (start_ms - end_ms, id)) AS longest_id,
        count(*) >= 5 AND sum(end_ms - start_ms) >= 60000 AND count(DISTINCT session_id) >= 2 AS eligible FROM user_segments GROUP BY 1"""),
    "insert_new": with_sql("reminders", """, fresh AS (SELECT r.* FROM reminders r WHERE status <> 'open' AND NOT EXISTS (SELECT 1 FROM reminders o WHERE o.status = 'open' AND o.session_id = r.session_id AND o.description = r.description))
        SELECT id, session_id, status FROM fresh QUALIFY session_id IS NULL OR row_number() OVER (PARTITION BY session_id, description ORDER BY id) = 1"""),
    "window_upsert": with_sql("transcripts", f""", {_LATEST}, {_WINDOWS}, old AS (SELECT * FROM windows WHERE start_ms < 60000)
        SELECT w.session_id, w.start_ms, CASE WHEN o.start_ms IS NOT NULL AND w.session_id % 2 = 1 THEN w.start_ms + 60000 ELSE w.start_ms + 90000 END AS end_ms,
            CASE WHEN o.start_ms IS NOT NULL AND w.session_id % 2 = 1 THEN 'running' ELSE 'pending' END AS status, CASE WHEN o.start_ms IS NULL THEN 0 ELSE 1 END AS attempts
        FROM windows w LEFT JOIN old o ON o.session_id = w.session_id AND o.start_ms = w.start_ms"""),
    "status_transitions": with_sql("reminders", """, n AS (SELECT *, CASE priority WHEN 'high' THEN 'archived' WHEN 'low' THEN 'open' ELSE status END AS new_status FROM reminders)
        SELECT id, new_status, CASE WHEN new_status = status THEN CASE WHEN status = 'archived' THEN created_s END WHEN new_status = 'archived' THEN 1000000000 END AS archived_at FROM n"""),
    "queue_claim": with_sql("reminders", f""", {_QUEUE}, c AS (SELECT *, CASE WHEN status = 'pending' AND attempts < 3 THEN row_number() OVER (PARTITION BY tenant_id, status = 'pending' AND attempts < 3 ORDER BY created_s, id) END AS place FROM queue)
        SELECT id, CASE WHEN place = 1 THEN 'running' ELSE status END AS status, attempts + CASE WHEN place = 1 THEN 1 ELSE 0 END AS attempts FROM c"""),
    "queue_finish": with_sql("reminders", f""", {_QUEUE} SELECT id, CASE WHEN status <> 'running' THEN status WHEN id % 3 = 0 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN id % 3 = 1 THEN 'pending' ELSE 'succeeded' END AS status, attempts FROM queue"""),
    "priority_board": with_sql("reminders", "SELECT id, status, priority FROM reminders WHERE tenant_id = 'src1' AND status NOT IN ('archived', 'pending') AND contains(lower(concat_ws(chr(10), title, description)), 'er')"),
    "prune_unstarred": with_sql("reminders", "SELECT id, tenant_id, status = 'completed' AS starred FROM reminders QUALIFY status = 'completed' OR row_number() OVER (PARTITION BY tenant_id, status = 'completed' ORDER BY created_s DESC, id) <= 30"),
    "evidence_match": with_sql("transcripts", """SELECT i.id AS item_id, arg_min(l.id, (l.start_ms, l.id)) AS line_id FROM transcripts i
        LEFT JOIN transcripts l ON l.session_id = i.session_id AND contains(lower(l.text), lower(string_split(i.text, ' ')[1])) GROUP BY i.id"""),
    "script_share": r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 3 THEN round(length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\p{L}]', '', 'g')), 6) END AS latin,
        length(regexp_replace(text, '[\s\p{P}\p{S}]', '', 'g')) >= 2 AS meaningful FROM documents""",
    "reminder_titles": with_sql("reminders", "SELECT id, coalesce(title, CASE WHEN strlen(description) > 60 THEN left(description, 57) || '...' ELSE description END) AS title, coalesce(priority, 'medium') AS priority FROM reminders"),
    "excerpts": with_sql("reminders", """SELECT id, CASE WHEN strlen(description) <= 280 THEN description
        ELSE left(description, (SELECT max(n) FROM range(70, 281) t(n) WHERE strlen(left(description, n)) <= 280)) || '…' END AS excerpt FROM reminders"""),
    "patch_reminders": with_sql("reminders", "SELECT id, CASE WHEN id % 2 = 0 THEN 'high' ELSE priority END AS priority, CASE WHEN id % 3 = 0 THEN 'New' ELSE title END AS title, status FROM reminders"),
    "cascade_delete": with_sql("reminders reminder_labels", "SELECT b.* FROM reminder_labels b WHERE NOT EXISTS (SELECT 1 FROM reminders r WHERE r.id = b.reminder_id AND r.status = 'archived')"),
    "unlink_speakers": with_sql("segments", "SELECT id, session_id, CASE WHEN speaker_id <> 'user' THEN speaker_id END AS speaker_id FROM segments"),
}
