"""Translation of lines in small batches through a provider, with retries and a cache."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators import store

#: Lines of one request, retries of a line, and texts that a language's cache holds.
BATCH, RETRIES, CACHE = 4, 2, 200


class Translator(Protocol):
    """A provider: from requests (session_id, language, lines: array of start_ms, id, text) to answers (session_id, language,
    answer: the model's text). A model is called inside mapInPandas; the default works by rule."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def marked(requests: DataFrame) -> DataFrame:
    """The default provider, by rule: lines behind their target language; it leaves out one in seven and answers one in five with a blank, by
    the length of the text."""
    kept = F.filter("lines", lambda l: F.length(l["text"]) % 7 != 0)
    said = F.transform(kept, lambda l: F.struct(l["id"].alias("id"), F.when(F.length(l["text"]) % 5 == 0, " ").otherwise(F.concat("language", F.lit(": "), l["text"])).alias("text")))
    return requests.select("session_id", "language", F.concat(F.lit("<think>so</think>```json\n"), F.to_json(F.struct(said.alias("translations"))), F.lit("\n```")).alias("answer"))


def in_language(column: Column, language: Column) -> Column:
    """Whether a text is written as its target language is; all languages in Latin letters count as one."""
    main = F.split_part(F.lower(language), F.lit("-"), F.lit(1))
    return F.when(main == "zh", text.looks_like(column, "zh")).when(main == "ja", text.looks_like(column, "ja")).otherwise(text.looks_like(column, "en"))


def classified(lines: DataFrame, cache: DataFrame) -> DataFrame:
    """lines (language, text and others) with status and translation: a text in its target language is its own translation,
    a cached one has that of the cache, all others are pending with no attempts."""
    known = cache.select("language", "text", F.col("translation").alias("__cached"))
    found = F.when(in_language(F.col("text"), F.col("language")), F.col("text")).otherwise(F.col("__cached"))
    out = lines.join(known, ["language", "text"], "left").withColumn("translation", found).drop("__cached")
    return out.withColumns({"status": F.when(F.col("translation").isNotNull(), "done").otherwise("pending"), "attempts": F.lit(0)})


def flush(lines: DataFrame, ask: Translator = marked, batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """lines (session_id, language, id, start_ms, text, status, attempts, translation) after one request for each session.

    The first pending lines of a session are asked for. An answered line is done; a blank answer is an error; a line that the
    answer leaves out, or whose answer can't be read, stays pending until its retries are used up.
    """
    asked = store.trim_pending(lines.where("status = 'pending'"), "session_id", batch).where("text <> ''")
    requests = asked.groupBy("session_id", "language").agg(F.array_sort(F.collect_list(F.struct("start_ms", "id", "text"))).alias("lines"))
    answers = ask(requests).select("session_id", "language", F.posexplode(text.translations(F.col("answer"))).alias("pos", "t"))
    said = answers.groupBy("session_id", "language", F.col("t.id").alias("id")).agg(F.max_by("t.text", "pos").alias("__said"))
    place = ["session_id", "language", "id"]
    out = lines.join(asked.select(*place, F.lit(True).alias("__asked")), place, "left").join(said, place, "left")
    done, tries = F.trim("__said") != "", F.col("attempts") + 1
    missed = F.col("__asked") & F.col("__said").isNull()
    new = {
        "status": F.when(done, "done").when(F.col("__said").isNotNull(), "error").when(missed, F.when(tries > retries, "error").otherwise("pending")).otherwise(F.col("status")),
        "attempts": F.when(missed, tries).otherwise(F.col("attempts")),
        "translation": F.when(done, F.col("__said")).otherwise(F.col("translation")),
    }
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in lines.columns])


def remembered(cache: DataFrame, new: DataFrame, most: int = CACHE) -> DataFrame:
    """The cache (language, text, translation, seq) with new rows of the same columns: the latest translation of a text counts,
    in the place of its first, and of each language the texts that came last stay."""
    rows = cache.unionByName(new).groupBy("language", "text").agg(F.max_by("translation", "seq").alias("translation"), F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("seq"), "text"))
    return rows.withColumn("__p", place).where(F.col("__p") <= most).drop("__p")
