"""Confirming of candidates for new speakers: one change set, applied to speakers, vectors and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from colloquy.operators import store

#: How many members give vectors, and the quality that is noted for them.
VECTORS, QUALITY = 3, 0.75
WHITE = r"^\s+|\s+$"


def judged(requests: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """requests (id, tenant_id, display_name, color, member_ids) with speaker_id and reason: why one is not carried out (no_members, no_name,
    no_segments, or done, if its speaker is there already), null if it is. A speaker's id follows from the request's, so that a request
    that comes again finds what it made."""
    named = requests.withColumns({"display_name": F.regexp_replace("display_name", WHITE, ""), "speaker_id": F.concat(F.lit("spk_"), F.col("id").cast("string"))})
    wanted = named.select(F.col("id").alias("request_id"), F.explode("member_ids").alias("id"))
    found = wanted.join(segments.select("id"), "id").groupBy(F.col("request_id").alias("id")).agg(F.count("*").alias("__found"))
    there = speakers.select(F.col("id").alias("speaker_id"), F.lit(True).alias("__there"))
    reason = (
        F.when(F.coalesce(F.size("member_ids"), F.lit(0)) <= 0, "no_members").when(F.coalesce("display_name", F.lit("")) == "", "no_name")
        .when(F.col("__found").isNull(), "no_segments").when(F.col("__there"), "done")
    )
    return named.join(found, "id", "left").join(there, "speaker_id", "left").withColumn("reason", reason).drop("__found", "__there")


def change_set(requests: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """One row for each member of the requests that are carried out, the whole of what changes: the speaker that comes to be, the
    member's place by length (ties by id) and, of the three longest, its vector; the audio that goes; and whether the member goes to this
    speaker, as the last request (by id) has a member that several ask for.

    segments: id, start_ms, end_ms, audio_ref, embedding (null: none). A member named twice by a request counts once.
    """
    go = judged(requests, segments, speakers).where("reason IS NULL")
    wanted = go.select(F.col("id").alias("request_id"), "speaker_id", "tenant_id", "display_name", "color", F.explode(F.array_distinct("member_ids")).alias("id"))
    rows = wanted.join(segments.select("id", "audio_ref", "embedding", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms")), "id")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("duration_ms"), "id"))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("request_id"))) == 1
    vector = F.when((F.col("place") <= VECTORS) & (F.size("embedding") > 0), F.col("embedding"))
    return rows.withColumns({"place": place, "assigned": last}).withColumn("embedding", vector).withColumnRenamed("id", "segment_id")


def written(changes: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The change set, written to a path and read again, and how many rows of each kind it changes, counted while it is written."""
    counts = Observation()
    first, vector, lost = F.col("place") == 1, F.col("embedding").isNotNull(), F.col("assigned") & F.col("audio_ref").isNotNull()
    seen = changes.observe(counts, *[F.count_if(c).alias(n) for n, c in {"speakers": first, "vectors": vector, "segments": F.col("assigned"), "files": lost}.items()])
    seen.write.mode("overwrite").parquet(path)
    return changes.sparkSession.read.schema(changes.schema).parquet(path), counts.get


def new_speakers(changes: DataFrame, now_s: int) -> DataFrame:
    """The speakers that a change set brings, as rows of the store."""
    rows = changes.where("place = 1")
    return rows.select(F.col("speaker_id").alias("id"), "tenant_id", "display_name", "color", F.lit("enrolled").alias("kind"), F.lit("active").alias("status"), F.lit(now_s).cast("long").alias("created_s"))


def new_vectors(changes: DataFrame) -> DataFrame:
    """The vectors that a change set brings. The longest member's is the primary one; if that has none, no other takes its place."""
    rows = changes.where("embedding IS NOT NULL")
    return rows.select(F.concat_ws("/", "speaker_id", "place").alias("id"), "speaker_id", "segment_id", "embedding", "duration_ms", F.lit(QUALITY).alias("quality"), (F.col("place") == 1).alias("is_primary"))


def applied(changes: DataFrame, speakers: DataFrame, vectors: DataFrame, segments: DataFrame, now_s: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """speakers, vectors and segments after a change set; applied to its own result it changes nothing."""
    fresh_speakers = new_speakers(changes, now_s).join(speakers.select("id"), "id", "left_anti")
    fresh_vectors = new_vectors(changes).join(vectors.select("id"), "id", "left_anti")
    given = changes.where("assigned").select(F.col("segment_id").alias("id"), F.col("speaker_id").alias("new_speaker"))
    return speakers.unionByName(fresh_speakers), vectors.unionByName(fresh_vectors), store.assign_segments(segments, given)


def files_to_go(changes: DataFrame) -> DataFrame:
    """Audio that no segment needs any more."""
    return changes.where("assigned AND audio_ref IS NOT NULL").select("segment_id", "audio_ref")


def by_occurrences(candidates: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Candidates with the most members first, those heard last first on ties."""
    return store.page(candidates, [F.desc("n_rows"), F.desc("last_ms"), F.asc("candidate")], limit, limit, offset)
