"""The registered queries over damaged answers, audio files, levels and confirmed candidates, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import repair, signal, times
from colloquy.operators import candidates, levels
from colloquy.sources import audio
from colloquy.sources import relations as R
from colloquy.sources.relations import SQL, with_sql

NOW_S = 10**9
BLOCK_MS = 700


def repaired_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = R.transcripts(spark, d)
    whole = F.to_json(F.struct("text"))
    body, key = F.substring(whole, F.lit(9), F.length(whole) - 9), F.col("id")
    item = F.concat(F.lit('{"description":'), body, F.lit(',"key":"'), key, F.lit('"}'))
    shapes = [
        item, F.concat(F.lit("```json\n"), item, F.lit("\n```")), F.concat(F.lit('{"key":"'), key, F.lit('","description":'), F.left(body, F.length(body) - 1)),
        F.concat(F.lit('{"description":'), body, F.lit(' "key":"'), key, F.lit('"}')), F.concat(F.lit('{"description":'), body, F.lit(',,"key":"'), key, F.lit('",}')),
        F.concat(F.lit("{key: '"), key, F.lit("', 'description': "), body, F.lit("}")), F.concat(F.lit('{"key":None,"description":'), body, F.lit("]}")),
        F.lit("no answer"), F.concat(F.lit("Sure: "), item, F.lit(" done.")),
    ]
    answer = F.element_at(F.array(*shapes), (F.floor(F.col("start_ms") / 15_000) % len(shapes) + 1).cast("int"))
    found = rows.select("id", repair.typed(answer, "description string, key string", ("description",)).alias("t"), repair.broken(answer).isNotNull().alias("was_broken"))
    return found.select("id", F.col("t.description").alias("description"), F.col("t.key").alias("item_key"), "was_broken")


def json_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    shapes = F.array("props", F.concat(F.lit("["), "props", F.lit("]")), F.col("event_id").cast("string"), F.lit("true"), F.to_json(F.struct("event_type")).substr(F.lit(15), F.length("event_type") + 2), F.lit("{bad"))
    return rows.select("event_id", repair.kind(F.element_at(shapes, (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


def wav_decode(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (i % by + 1).cast("int"))
    files = R.voices(spark, d).select("id", audio.encoded(F.col("embedding"), pick((16_000, 32_000, 8_000), 3), (i % 2 + 1).cast("int"), pick((8, 16, 24, 32, 32), 5), i % 5 == 4).alias("content"))
    files = files.withColumn("content", F.when(i % 13 == 0, F.substring("content", 1, 100)).otherwise(F.col("content")))
    found = files.select("id", audio.decoded(F.col("content")).alias("f"), F.size(audio.decoded(F.col("content"), strict=True)["samples"]).alias("n_strict"))
    total = F.aggregate("f.samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("id", F.size("f.samples").alias("n"), F.col("f.duration_ms").alias("duration_ms"), F.round(total, 3).alias("total"), "n_strict")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    samples = F.when(i % 17 != 0, F.col("embedding"))
    chunks = R.voices(spark, d).select((F.col("speaker_id") % 3).alias("session_id"), (i * 9 + i % 4).alias("at_ms"), i.alias("seq"), F.when(samples.isNotNull(), signal.rms(samples)).alias("rms"))
    return levels.smoothed(chunks, BLOCK_MS)


def session_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("session_id", "at_ms", F.round("level", 6).alias("level"))


def level_reports(spark: SparkSession, d: str) -> DataFrame:
    return levels.reported(_levels(spark, d), block_ms=BLOCK_MS).select("session_id", "at_ms", F.round("level", 6).alias("level"))


def _confirming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests for the segments of clips, segments with small vectors, and speakers that some requests made before."""
    segments = R.clip_segments(spark, d).withColumn("embedding", F.when(F.col("has_vector"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0))))
    groups = segments.where("id % 2 = 0").groupBy("session_id", "clip_id").agg(F.collect_list("id").alias("ids"))
    s = F.col("session_id")
    ids = F.when(s % 7 == 3, F.transform("ids", lambda x: -x - 1)).when(s % 13 == 5, F.array().cast("array<long>")).otherwise(F.col("ids"))
    both = groups.select("session_id", "clip_id", F.inline(F.array(F.struct(F.lit("a").alias("part"), ids.alias("member_ids")), F.struct(F.lit("b").alias("part"), F.when(s % 6 == 1, F.filter(ids, lambda x: x % 4 == 0)).alias("member_ids")))))
    name = F.when(s % 5 == 0, " \t").otherwise(F.concat(F.lit(" Voice "), "clip_id", F.lit(" ")))
    requests = both.where("member_ids IS NOT NULL").select(F.concat("clip_id", "part").alias("id"), (s % 4).alias("tenant_id"), name.alias("display_name"), F.lit("#1d4ed8").alias("color"), "member_ids")
    speakers = groups.where(s % 11 == 4).select(F.concat(F.lit("spk_"), "clip_id", F.lit("a")).alias("id"))
    return requests, segments, speakers


def confirm_requests(spark: SparkSession, d: str) -> DataFrame:
    requests, segments, speakers = _confirming(spark, d)
    changes = candidates.change_set(requests, segments, speakers)
    lost = F.col("assigned") & F.col("audio_ref").isNotNull()
    sums = changes.groupBy(F.col("request_id").alias("id")).agg(F.count("*").alias("n_members"), F.count("embedding").alias("n_vectors"), F.count_if("assigned").alias("n_assigned"), F.count_if(lost).alias("n_files"), F.max(F.when(F.col("place") == 1, F.col("segment_id"))).alias("longest"))
    return candidates.judged(requests, segments, speakers).select("id", "display_name", "reason").join(sums, "id", "left")


def confirmed_segments(spark: SparkSession, d: str) -> DataFrame:
    requests, segments, speakers = _confirming(spark, d)
    changes = candidates.change_set(requests, segments, speakers)
    given = changes.where("assigned").select(F.col("segment_id").alias("id"), F.col("speaker_id").alias("new_speaker"))
    return candidates.store.assign_segments(segments, given).select("id", "speaker_id", "audio_ref")


def asked_due(spark: SparkSession, d: str) -> DataFrame:
    """Local times around the nights when the clocks of New York change."""
    i = F.col("event_id")
    base = F.when(i % 2 == 0, F.lit("2024-03-09 12:00:00")).otherwise("2024-11-02 12:00:00").cast("timestamp")
    local = F.timestamp_seconds(F.unix_timestamp(base) + i * 7 % 2880 * 60)
    texts = [F.date_format(local, f) for f in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "y-M-d H:m", "dd.MM.yyyy")]
    text = F.when(i % 4 == 0, texts[0]).when(i % 4 == 1, texts[1]).when(i % 4 == 2, texts[2]).otherwise(texts[3])
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", times.asked_due(text, "America/New_York").alias("due"))


QUERIES = {f.__name__: f for f in (repaired_answers, json_kinds, wav_decode, session_levels, level_reports, confirm_requests, confirmed_segments, asked_due)}

_LEVELS = f"""WITH RECURSIVE voices AS ({SQL["voices"]}), chunks AS (SELECT speaker_id % 3 AS session_id, id * 9 + id % 4 AS at_ms, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)) AS rms FROM voices WHERE id % 17 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms) AS k FROM chunks),
    l AS (SELECT session_id, k, at_ms, CAST(0.3 * rms AS DOUBLE) AS level, at_ms AS sent_at, true AS sent FROM n WHERE k = 1
        UNION ALL SELECT n.session_id, n.k, n.at_ms, 0.7 * l.level + 0.3 * n.rms, CASE WHEN n.at_ms >= l.sent_at + 66 THEN n.at_ms ELSE l.sent_at END, n.at_ms >= l.sent_at + 66 FROM l JOIN n ON n.session_id = l.session_id AND n.k = l.k + 1)
    SELECT session_id, at_ms, round(level, 6) AS level FROM l"""
_TURN = "start_ms // 15000 % 9"
_CONFIRMING = with_sql("clip_segments", """, groups AS (SELECT session_id, clip_id, list(id) AS ids FROM clip_segments WHERE id % 2 = 0 GROUP BY ALL),
    asked AS (SELECT *, CASE WHEN session_id % 7 = 3 THEN list_transform(ids, lambda x: -x - 1) WHEN session_id % 13 = 5 THEN [] ELSE ids END AS m FROM groups),
    requests AS (SELECT session_id, clip_id || 'a' AS id, m FROM asked UNION ALL SELECT session_id, clip_id || 'b', list_filter(m, lambda x: x % 4 = 0) FROM asked WHERE session_id % 6 = 1),
    judged AS (SELECT r.id, CASE WHEN session_id % 5 = 0 THEN '' ELSE 'Voice ' || left(r.id, length(r.id) - 1) END AS display_name, m, CASE WHEN len(m) = 0 THEN 'no_members' WHEN session_id % 5 = 0 THEN 'no_name'
        WHEN session_id % 7 = 3 THEN 'no_segments' WHEN session_id % 11 = 4 AND r.id LIKE '%a' THEN 'done' END AS reason FROM requests r),
    members AS (SELECT j.request_id, s.*, row_number() OVER (PARTITION BY request_id ORDER BY end_ms - start_ms DESC, s.id) AS place, row_number() OVER (PARTITION BY s.id ORDER BY request_id DESC) = 1 AS assigned
        FROM (SELECT id AS request_id, unnest(m) AS member FROM judged WHERE reason IS NULL) j JOIN clip_segments s ON s.id = j.member)""")

ORACLE_SQL = {
    "repaired_answers": with_sql("transcripts", f"""SELECT id, CASE WHEN {_TURN} <> 7 THEN text END AS description, CASE WHEN {_TURN} NOT IN (6, 7) THEN id END AS item_key, {_TURN} > 1 AS was_broken FROM transcripts"""),
    "json_kinds": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' WHEN 4 THEN 'string' END AS kind FROM events",
    "wav_decode": with_sql("voices", """, f AS (SELECT id, [16000, 32000, 8000][id % 3 + 1] AS rate, id % 2 + 1 AS channels, [8, 16, 24, 32, 32][id % 5 + 1] AS bits, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM voices),
        q AS (SELECT *, CASE WHEN id % 5 = 4 THEN e ELSE list_transform(e, lambda x: greatest(-power(2, bits - 1), least(power(2, bits - 1) - 1, floor(x * power(2, bits - 1) + 0.5))) / power(2, bits - 1)) END AS v FROM f),
        m AS (SELECT *, CASE channels WHEN 1 THEN v ELSE list_transform(range(len(v) // 2), lambda k: (v[2 * k + 1] + v[2 * k + 2]) / 2) END AS mono FROM q),
        r AS (SELECT *, CASE rate WHEN 16000 THEN mono WHEN 32000 THEN list_transform(range(len(mono) // 2), lambda k: mono[2 * k + 1])
            ELSE list_transform(range(2 * len(mono)), lambda k: (mono[k // 2 + 1] + mono[least((k + 1) // 2 + 1, len(mono))]) / 2) END AS samples FROM m)
        SELECT id, CASE WHEN id % 13 <> 0 THEN CAST(len(samples) AS INTEGER) END AS n, CASE WHEN id % 13 <> 0 THEN len(samples) / 16000.0 * 1000 END AS duration_ms, CASE WHEN id % 13 <> 0 THEN round(list_sum(samples), 3) END AS total,
            CASE WHEN rate = 16000 AND channels = 1 THEN CAST(CASE WHEN id % 13 = 0 THEN 56 // (bits // 8) ELSE len(samples) END AS INTEGER) END AS n_strict FROM r"""),
    "asked_due": """WITH l AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-03-09 12:00:00' ELSE TIMESTAMP '2024-11-02 12:00:00' END + to_minutes(event_id * 7 % 2880) AS t FROM events)
        SELECT event_id, CASE WHEN event_id % 4 = 3 OR t >= '2024-03-10 02:00:00'::TIMESTAMP AND t < '2024-03-10 03:00:00'::TIMESTAMP OR t >= '2024-11-03 01:00:00'::TIMESTAMP AND t < '2024-11-03 02:00:00'::TIMESTAMP THEN NULL
            ELSE strftime(t + to_hours(CASE WHEN t >= '2024-03-10 03:00:00'::TIMESTAMP AND t < '2024-11-03 01:00:00'::TIMESTAMP THEN 4 ELSE 5 END), '%Y-%m-%d %H:%M:%S') END AS due FROM l""",
    "session_levels": _LEVELS,
    "level_reports": _LEVELS + " WHERE sent",
    "confirm_requests": _CONFIRMING + """, sums AS (SELECT request_id AS id, count(*) AS n_members, count(*) FILTER (place <= 3 AND has_vector) AS n_vectors, count(*) FILTER (assigned) AS n_assigned,
            count(*) FILTER (assigned AND audio_ref IS NOT NULL) AS n_files, max(members.id) FILTER (place = 1) AS longest FROM members GROUP BY request_id)
        SELECT j.id, display_name, reason, n_members, n_vectors, n_assigned, n_files, longest FROM judged j LEFT JOIN sums USING (id)""",
    "confirmed_segments": _CONFIRMING + """SELECT s.id, CASE WHEN m.id IS NOT NULL THEN 'spk_' || request_id ELSE s.speaker_id END AS speaker_id, CASE WHEN m.id IS NULL THEN s.audio_ref END AS audio_ref
        FROM clip_segments s LEFT JOIN members m ON m.id = s.id AND m.assigned""",
}
