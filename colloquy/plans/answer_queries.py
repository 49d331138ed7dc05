"""The registered queries over models' answers, translation and the naming of clips' speakers, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import Settings
from colloquy.functions import text
from colloquy.operators import clustering, translation
from colloquy.sources import relations as R
from colloquy.sources.relations import with_sql

CLIPS = Settings(cluster_distance=0.75, cluster_min_segments=2, cluster_min_ms=8_000, confirm=0.3)
LANGUAGES = ("en", "zh-CN", "ja")


def _turn() -> Column:
    return F.floor(F.col("start_ms") / 15_000)


def todo_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = R.transcripts(spark, d)
    item = F.to_json(F.struct(F.col("text").alias("description"), F.array("id").alias("labels")))
    bad = F.to_json(F.struct(F.col("id").alias("title")))
    shapes = [item, F.concat(F.lit('{"todos": ['), item, F.lit(", "), item, F.lit("]}")), F.concat(F.lit("```json\n["), item, F.lit("]\n```")), F.concat(F.lit("so</think> Here: "), item, F.lit(" and more")), F.concat(F.lit("<think>"), item, F.lit("</think>"), bad), F.concat(F.lit("List: ["), item, F.lit("] "), bad)]
    answer = F.element_at(F.array(*shapes), (_turn() % len(shapes) + 1).cast("int"))
    found = rows.select("id", text.todos(answer).alias("t"))
    return found.select("id", F.size("t").alias("n"), F.array_join("t.description", "|").alias("descriptions"), F.array_join(F.flatten("t.labels"), "|").alias("labels"))


def translation_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = R.transcripts(spark, d)
    pair = F.to_json(F.struct("id", "text"))
    example = F.lit('{"translations": [{"id": "0", "text": "example"}]} ')
    whole = F.concat(F.lit('{"translations": ['), pair, F.lit("]}"))
    shapes = [whole, F.concat(example, whole, F.lit("]}]")), F.concat(F.lit("```\n["), pair, F.lit(", "), pair, F.lit("]")), F.concat(F.lit("<think>"), example, F.lit("</think>"), F.col("text")), F.concat(example, F.lit("</think>[1] ["), pair, F.lit("]"))]
    answer = F.element_at(F.array(*shapes), (_turn() % len(shapes) + 1).cast("int"))
    found = rows.select("id", text.translations(answer).alias("t"))
    return found.select("id", F.size("t").alias("n"), F.array_join("t.text", "|").alias("texts"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("session_id") % 3 + 1).cast("int"))
    fresh = R.transcripts(spark, d).where("is_final").select("session_id", language.alias("language"), "id", "start_ms", "text", F.lit("pending").alias("status"), (_turn() % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("translation"))
    return fresh


def translation_flush(spark: SparkSession, d: str) -> DataFrame:
    return translation.flush(_pending(spark, d)).select("session_id", "id", "status", "attempts", "translation")


def translation_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _pending(spark, d)
    cache = rows.where(F.length("text") % 4 == 0).select("language", "text").distinct().withColumn("translation", F.concat(F.lit("cached "), "text"))
    return translation.classified(rows.drop("status", "attempts", "translation"), cache).select("id", "status", "translation")


def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = _pending(spark, d).select("language", F.left("text", F.lit(30)).alias("text"), F.col("id").alias("translation"), (F.col("session_id") * 1000 + _turn()).alias("seq"))
    return translation.remembered(rows.where("session_id % 2 = 0"), rows.where("session_id % 2 = 1"), 50)


def clip_members(spark: SparkSession, d: str) -> DataFrame:
    clip = F.concat_ws("-", "speaker_id", F.floor(F.col("id") / 100).cast("string"))
    return R.voices(spark, d).select((F.col("id") % 4).alias("tenant_id"), F.concat_ws("-", clip, F.col("id") % 4).alias("clip_id"), "id", (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 5000).alias("end_ms"), "embedding")


def clip_speakers(spark: SparkSession, d: str) -> DataFrame:
    known = R.voices(spark, d).where("id % 7 = 0").select((F.col("id") % 4).alias("tenant_id"), F.concat(F.lit("s"), F.col("speaker_id").cast("string")).alias("speaker_id"), (F.col("speaker_id").cast("string") > "5").alias("provisional"), "embedding")
    return clustering.assign_clips(clip_members(spark, d), known, CLIPS)


def speaker_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = clip_members(spark, d).withColumns({"session_id": F.col("id") % 5, "scope": F.split_part("clip_id", F.lit("-"), F.lit(1))})
    scope = F.concat_ws("-", "scope", F.floor(F.col("id") / 1000).cast("string"))
    return clustering.candidate_list(rows.withColumn("scope", scope), "scope", 0.2, min_ms=20_000).withColumn("member_ids", F.array_join("member_ids", ","))


QUERIES = {f.__name__: f for f in (todo_answers, translation_answers, translation_flush, translation_status, translation_cache, clip_speakers, speaker_candidates)}

_PENDING = "pending AS (SELECT session_id, id, start_ms, text, CASE session_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-CN' ELSE 'ja' END AS language, start_ms // 15000 % 3 AS attempts, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, id) AS place FROM transcripts WHERE is_final)"
_COUNTS = "counts AS (SELECT *, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin, length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) AS cjk, length(regexp_replace(text, '[^぀-ヿ]', '', 'g')) AS kana FROM pending)"

#: clip_speakers and speaker_candidates go by the order of rows, which SQL cannot state; tests hold them against known cases.
ORACLE_SQL = {
    "todo_answers": with_sql("transcripts", """SELECT id, CASE start_ms // 15000 % 6 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS n, CASE start_ms // 15000 % 6 WHEN 1 THEN text || '|' || text WHEN 4 THEN '' ELSE text END AS descriptions,
        CASE start_ms // 15000 % 6 WHEN 1 THEN id || '|' || id WHEN 4 THEN '' ELSE id END AS labels FROM transcripts"""),
    "translation_answers": with_sql("transcripts", """SELECT id, CASE start_ms // 15000 % 5 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS n,
        CASE start_ms // 15000 % 5 WHEN 2 THEN text || '|' || text WHEN 3 THEN NULL ELSE text END AS texts FROM transcripts"""),
    "translation_flush": with_sql("transcripts", f""", {_PENDING}, f AS (SELECT *, place <= 4 AND text <> '' AS asked, length(text) % 7 = 0 AS missed, length(text) % 5 = 0 AS blank FROM pending)
        SELECT session_id, id, CASE WHEN NOT asked THEN 'pending' WHEN missed THEN CASE WHEN attempts = 2 THEN 'error' ELSE 'pending' END WHEN blank THEN 'error' ELSE 'done' END AS status,
        CAST(attempts + CAST(asked AND missed AS INTEGER) AS INTEGER) AS attempts, CASE WHEN asked AND NOT missed AND NOT blank THEN language || ': ' || text END AS translation FROM f"""),
    "translation_status": with_sql("transcripts", f""", {_PENDING}, {_COUNTS}, f AS (SELECT *, latin + cjk + kana >= 3 AND CASE language WHEN 'en' THEN latin >= 0.7 * (latin + cjk + kana)
            WHEN 'ja' THEN kana > 0 AND kana + cjk >= 0.7 * (latin + cjk + kana) ELSE kana = 0 AND cjk >= 0.7 * (latin + cjk + kana) END AS own FROM counts)
        SELECT id, CASE WHEN own OR length(text) % 4 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN own THEN text WHEN length(text) % 4 = 0 THEN 'cached ' || text END AS translation FROM f"""),
    "translation_cache": with_sql("transcripts", f""", {_PENDING}, r AS (SELECT language, left(text, 30) AS text, id, session_id * 1000 + start_ms // 15000 AS seq FROM pending)
        SELECT language, text, arg_max(id, seq) AS translation, min(seq) AS seq FROM r GROUP BY language, text QUALIFY row_number() OVER (PARTITION BY language ORDER BY min(seq) DESC, text) <= 50"""),
}
