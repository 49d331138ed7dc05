"""Lists and changes of the store: sessions, segments, clips, speakers, labels and transcripts.

Changes are functions of the state before: each gives the whole new relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a tenant starts with, each with the colours of its text and its ground.
FIRST_LABELS = (
    ("Work", "#1d4ed8", "#dbeafe"),
    ("Personal", "#6d28d9", "#ede9fe"),
    ("Urgent", "#b91c1c", "#fee2e2"),
    ("Idea", "#a16207", "#fef3c7"),
    ("Follow-up", "#15803d", "#dcfce7"),
    ("Meeting", "#0e7490", "#cffafe"),
)


def page(rows: DataFrame, order: list[Column], limit: int, most: int, offset: int = 0, least: int = 0) -> DataFrame:
    """Rows in order, at most limit of them, limit itself between least and most."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(least, min(limit, most)))


def latest_open_session(sessions: DataFrame, tenant: str, mode: str = "always_on") -> DataFrame:
    rows = sessions.where((F.col("tenant_id") == tenant) & (F.col("mode") == mode) & F.col("ended_s").isNull())
    return rows.orderBy(F.desc("started_s"), "id").limit(1)


def latest_open_sessions(sessions: DataFrame, mode: str = "always_on") -> DataFrame:
    """The latest open session of every tenant."""
    rows = sessions.where((F.col("mode") == mode) & F.col("ended_s").isNull())
    return rows.groupBy("tenant_id").agg(F.min(F.struct((-F.col("started_s")).alias("later"), "id"))["id"].alias("session_id"))


def end_sessions(sessions: DataFrame, ended: DataFrame, now_s: int) -> DataFrame:
    """sessions with those of ended (id) ended now; an end that is there already is overwritten too."""
    marked = sessions.join(ended.select("id", F.lit(True).alias("__now")), "id", "left")
    return marked.withColumn("ended_s", F.when(F.col("__now"), F.lit(now_s)).otherwise(F.col("ended_s"))).select(*sessions.columns)


def of_active_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows (session_id) of sessions that have not ended."""
    return rows.join(sessions.where("ended_s IS NULL").select(F.col("id").alias("session_id")), "session_id", "left_semi")


def unknown_segments(segments: DataFrame, session: int | None, limit: int) -> DataFrame:
    """Segments without a speaker: of one session from its start, or of all from the latest on."""
    rows = segments.where("speaker_id IS NULL")
    return rows.where(F.col("session_id") == session).orderBy("start_ms", "id").limit(limit) if session is not None else rows.orderBy(F.desc("start_ms"), "id").limit(limit)


def retained_candidates(segments: DataFrame, session: int | None, limit: int) -> DataFrame:
    """Segments kept to be asked about: with audio and a vector, not dismissed; as in unknown_segments."""
    return unknown_segments(segments.where("audio_ref IS NOT NULL AND has_vector AND dismissed_s IS NULL"), session, limit)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among ids (id); none for no ids."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def missing_ids(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were asked for and have no row."""
    return ids.select("id").distinct().join(rows.select(F.col(key).alias("id")), "id", "left_anti")


def archive_clips(clips: DataFrame, limit: int = 50) -> DataFrame:
    """Processed and empty clips, the latest first, 1 to 500 of them, with their length."""
    rows = clips.where(F.col("status").isin("processed", "empty")).withColumn("duration_ms", F.col("ended_at_ms") - F.col("started_at_ms"))
    return page(rows, [F.desc("started_at_ms"), F.asc("id")], limit, 500, least=1)


def merge_clips(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """All clips of both sides by id: what they say of a clip, our star on it, and clips that only we have."""
    o = ours.select("id", F.col("text").alias("our_text"), F.col("starred").alias("our_star"))
    both = theirs.select("id", "text").join(o, "id", "full")
    return both.select("id", F.coalesce("text", "our_text").alias("text"), F.coalesce("our_star", F.lit(False)).alias("starred"))


def active_speakers(speakers: DataFrame, tenant: str) -> DataFrame:
    return speakers.where((F.col("tenant_id") == tenant) & (F.col("status") == "active")).orderBy("display_name", "id")


def provisional_speakers(speakers: DataFrame) -> DataFrame:
    return speakers.where("kind = 'provisional' AND status = 'active'").orderBy(F.desc_nulls_last("last_matched_s"), "id")


def stale_provisionals(speakers: DataFrame, now_s: int, days: int) -> DataFrame:
    """Provisional speakers that no match has touched for so many days; one that was never matched is stale."""
    return speakers.where((F.col("kind") == "provisional") & (F.col("last_matched_s").isNull() | (F.col("last_matched_s") < now_s - days * 86_400)))


def promote(speakers: DataFrame, names: DataFrame) -> DataFrame:
    """Provisional speakers of names (id, new_name) become enrolled, under the new name if there is one."""
    j = speakers.join(names.select("id", "new_name", F.lit(True).alias("__on")), "id", "left")
    on = F.coalesce("__on", F.lit(False)) & (F.col("kind") == "provisional")
    named = {"display_name": F.when(on, F.coalesce("new_name", "display_name")).otherwise(F.col("display_name")), "kind": F.when(on, "enrolled").otherwise(F.col("kind")), "last_matched_s": F.when(~on, F.col("last_matched_s"))}
    return j.select(*[named.get(c, F.col(c)).alias(c) for c in speakers.columns])


def touch(speakers: DataFrame, matched: DataFrame, now_s: int) -> DataFrame:
    """Provisional speakers of matched (id) count as matched now."""
    j = speakers.join(matched.select("id", F.lit(True).alias("__on")), "id", "left")
    on = F.coalesce("__on", F.lit(False)) & (F.col("kind") == "provisional")
    return j.withColumn("last_matched_s", F.when(on, F.lit(now_s)).otherwise(F.col("last_matched_s"))).select(*speakers.columns)


def dismiss_segments(segments: DataFrame, ids: DataFrame, now_s: int) -> DataFrame:
    """The segments of ids (id) are dismissed now and lose their audio."""
    j = segments.join(ids.select("id", F.lit(True).alias("__on")), "id", "left")
    return j.withColumn("dismissed_s", F.when(F.col("__on"), F.lit(now_s)).otherwise(F.col("dismissed_s"))).withColumn("audio_ref", F.when(F.col("__on").isNull(), F.col("audio_ref"))).select(*segments.columns)


def assign_segments(segments: DataFrame, given: DataFrame) -> DataFrame:
    """The segments of given (id, new_speaker) get that speaker, a null takes theirs away; they lose their audio
    if they got one."""
    j = segments.join(given.select("id", "new_speaker", F.lit(True).alias("__on")), "id", "left")
    lost = F.col("__on").isNotNull() & F.col("new_speaker").isNotNull()
    return j.withColumn("speaker_id", F.when(F.col("__on"), F.col("new_speaker")).otherwise(F.col("speaker_id"))).withColumn("audio_ref", F.when(~lost, F.col("audio_ref"))).select(*segments.columns)


def upsert(state: DataFrame, rows: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """state with rows put in by key; of a known key all columns change but those of keep."""
    new = rows.select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in state.columns if c not in key])
    both = state.withColumn("__old", F.lit(True)).join(new, key, "full")
    take = lambda c: F.when(F.col("__new") & (F.col("__old").isNull() | F.lit(c not in keep)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in key else take(c) for c in state.columns])


def replace_all(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with all that new's keys had replaced by what new has."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def seed_labels(labels: DataFrame, tenants: DataFrame) -> DataFrame:
    """labels (tenant_id, name, color, bg_color) with the first ones for every tenant that has none at all."""
    bare = tenants.select("tenant_id").distinct().join(labels.select("tenant_id"), "tenant_id", "left_anti")
    first = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("name", "color", "bg_color"), row, strict=True)]) for row in FIRST_LABELS]
    return labels.select("tenant_id", "name", "color", "bg_color").unionByName(bare.select("tenant_id", F.inline(F.array(*first))))


def add_finals(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Final lines as they are stored: a segment that does not exist becomes null."""
    known = segments.select(F.col("id").alias("segment_id"), F.lit(True).alias("__known"))
    return lines.join(known, "segment_id", "left").withColumn("segment_id", F.when(F.col("__known"), F.col("segment_id"))).select(*lines.columns)


def tagged_text(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """Lines with their text behind the speaker's name in brackets, UNKNOWN without a known speaker."""
    names = speakers.select(F.col("id").alias("speaker_id"), "display_name")
    tag = F.coalesce("display_name", F.lit("UNKNOWN"))
    return lines.join(names, "speaker_id", "left").withColumn("text", F.concat(F.lit("["), tag, F.lit("] "), F.col("text"))).select(*lines.columns)


def longest_members(members: DataFrame, most: int = 3) -> DataFrame:
    """The longest members of each cluster (cluster, id, place); the first is the primary one."""
    length = F.col("end_ms") - F.col("start_ms")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(length), "id"))
    return members.select("cluster", "id", place.alias("place")).where(F.col("place") <= most).withColumn("is_primary", F.col("place") == 1)


def gated_clusters(members: DataFrame, min_rows: int, min_ms: int) -> DataFrame:
    """Clusters of a clip with so many segments and so much time."""
    totals = members.groupBy("clip_id", "cluster").agg(F.count("*").alias("n_rows"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    return totals.where((F.col("n_rows") >= min_rows) & (F.col("total_ms") >= min_ms))


def candidate_pool(vectors: DataFrame, speakers: DataFrame, tenant: str, dimension: int, kind: str | None = None) -> DataFrame:
    """Vectors (id, person_id, embedding) of a tenant's active speakers, of one length and perhaps one kind."""
    who = speakers.where((F.col("tenant_id") == tenant) & (F.col("status") == "active"))
    who = who if kind is None else who.where(F.col("kind") == kind)
    return vectors.where(F.size("embedding") == dimension).join(who.select(F.col("id").alias("person_id"), "kind"), "person_id")


def trim_pending(lines: DataFrame, by: str, most: int = 4) -> DataFrame:
    """The first so many pending lines of each group: what one request takes."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "id"))
    return lines.withColumn("__p", place).where(F.col("__p") <= most).drop("__p")
