"""Text functions: normalising of extracted items, excerpts, scripts, and recovery of JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.times import once

#: What counts as no value, and the words for priorities and confidences.
NO_VALUE = ("", "null", "none", "n/a", "na", "undefined", "-")
PRIORITY_WORDS = {"high": ("high", "urgent", "critical"), "medium": ("medium", "med", "normal"), "low": ("low", "minor")}


def excerpt(column: Column, most: int = 280) -> Column:
    """A text of at most so many bytes; a longer one ends at a whole character before, with an
    ellipsis."""
    data = F.encode(column, "UTF-8")
    inside = [F.substring(F.hex(F.substring(data, most + 1 - k, 1)), 1, 1).isin("8", "9", "A", "B") for k in range(4)]
    best = F.coalesce(*[F.when(~i, F.substring(data, 1, most - k).cast("string")) for k, i in enumerate(inside)])
    return F.when(F.octet_length(column) <= most, column).otherwise(F.concat(best, F.lit("…")))


def title_or_text(title: Column, text: Column) -> Column:
    """The title, else the text: whole up to 60 bytes, else its first 57 characters and three dots."""
    return F.coalesce(title, F.when(F.octet_length(text) > 60, F.concat(F.left(text, F.lit(57)), F.lit("..."))).otherwise(text))


def clean_value(column: Column) -> Column:
    """Trimmed; null if it only says that there is no value."""
    text = F.trim(column)
    return F.when(~F.lower(text).isin(*NO_VALUE), text)


def clean_priority(column: Column) -> Column:
    word, out = F.lower(F.trim(column)), F.lit(None).cast("string")
    for name, words in PRIORITY_WORDS.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def status_by_confidence(confidence: Column) -> Column:
    """open for high, pending for medium, else null: such an item is dropped."""
    return F.when(confidence == "high", "open").when(confidence == "medium", "pending")


def without_thoughts(column: Column) -> Column:
    """Text outside think tags; an opened one that never closes cuts the rest."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def without_fence(column: Column) -> Column:
    """What stands within the first code fence, else the text."""
    inner = F.regexp_extract(column, r"(?s)```[a-zA-Z]*\s*\n(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(column))


def meaningful(column: Column) -> Column:
    """Two characters or more besides white space, punctuation and signs."""
    return F.length(F.regexp_replace(column, r"[\s\p{P}\p{S}]", "")) >= 2


def script_share(column: Column, script: str) -> Column:
    """Share of letters of a Unicode script among all letters; null with fewer than three."""
    letters = F.length(F.regexp_replace(column, r"[^\p{L}]", ""))
    return F.when(letters >= 3, F.length(F.regexp_replace(column, rf"[^\p{{{script}}}]", "")) / letters)


def looks_like(column: Column, language: str) -> Column:
    """Whether a text is written as its language is: at least 3 letters, seven tenths of the script. Chinese has no
    kana, Japanese has some. Letters: Latin, unified ideographs and kana; all else is passed over."""
    return written_as(letters(column), language)


def letters(column: Column) -> Column:
    """How many Latin letters, unified ideographs and kana a text has (latin, cjk, kana)."""
    # what is left out goes in runs, not sign by sign; the array of one row works the text out once and not once a script
    count = lambda t, kept: F.length(F.regexp_replace(t, f"[^{kept}]+", ""))
    scripts = (("latin", "A-Za-zÀ-ɏ"), ("cjk", "一-鿿㐀-䶿"), ("kana", "぀-ヿ"))
    return once(F.coalesce(column, F.lit("")), lambda t: F.struct(*[count(t, kept).alias(name) for name, kept in scripts]))


def written_as(counts: Column, language: str) -> Column:
    """looks_like of a text with these counts of letters."""

    def fits(n: Column) -> Column:
        latin, cjk, kana = n["latin"], n["cjk"], n["kana"]
        total = latin + cjk + kana
        by_language = {"zh": (cjk >= 0.7 * total) & (kana == 0), "ja": (kana > 0) & (kana + cjk >= 0.7 * total)}
        return (total >= 3) & by_language.get(language, latin >= 0.7 * total)

    return once(counts, fits)


def ascii_lower(column: Column) -> Column:
    """A to Z in lower case; all other letters stay as they are, so that only ASCII is compared without regard to case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_quoted_line(items: DataFrame, lines: DataFrame) -> DataFrame:
    """(item_id, line_id): the first line of the item's session that contains the item's quote,
    without regard to case; null without one."""
    l = lines.select("session_id", F.struct("start_ms", F.col("id").alias("line_id")).alias("line"), F.lower("text").alias("line_text"))  # noqa: E741
    met = items.join(l, "session_id").where(F.col("line_text").contains(F.lower("quote")))
    first = met.groupBy("item_id").agg(F.min("line").alias("line"))
    return items.select("item_id").join(first, "item_id", "left").select("item_id", F.col("line.line_id").alias("line_id"))


def balanced_blocks(text: str | None, opening: str = "{", closing: str = "}") -> list[str]:
    """Top-level bracketed parts; brackets within strings don't count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for k, c in enumerate(text or ""):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == opening:
            start = k if depth == 0 else start
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : k + 1])
    return out


def _items(value: object) -> list | None:
    if isinstance(value, dict):
        value = next((value[k] for k in ("items", "todos") if isinstance(value.get(k), list)), None)
    return value if isinstance(value, list) else None


def recover_items(text: str | None) -> list[dict]:
    """The items of a model's answer: the whole as JSON, else without thoughts and fence, else the
    last bracketed part that can be read; nothing otherwise."""
    text = re.sub(r"(?s)<think>.*?(</think>|$)", "", text or "").strip()
    fence = re.search(r"(?s)```[a-zA-Z]*\s*\n(.*?)```", text)
    tries = [text, *([fence[1]] if fence else []), *reversed(balanced_blocks(text)), *reversed(balanced_blocks(text, "[", "]"))]
    for t in tries:
        try:
            found = _items(json.loads(t))
        except ValueError:
            continue
        if found is not None:
            return [x for x in found if isinstance(x, dict)]
    return []


def recovered(column: Column) -> Column:
    """The items of each answer as JSON texts with sorted keys."""

    @F.pandas_udf("array<string>")
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in recover_items(t)])

    return items(column)


def _is_todo(value: object) -> bool:
    """An object with a description; other fields are texts or nothing, labels are texts."""
    if not isinstance(value, dict) or not isinstance(value.get("description"), str):
        return False
    labels = value.get("labels", [])
    return isinstance(labels, list) and all(isinstance(x, str) for x in labels) and all(isinstance(value.get(k), str | None) for k in ("title", "priority", "due_time"))


def _todos(block: str, kinds: tuple[type, ...]) -> list[dict] | None:
    """One item, the items of a todos field, or a list of items, of the kinds of JSON allowed; None if it is none of them."""
    try:
        value = json.loads(block)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, kinds):
        return None
    if _is_todo(value):
        return [value]
    rows = value.get("todos") if isinstance(value, dict) else value
    return rows if isinstance(rows, list) and all(map(_is_todo, rows)) else None


def recover_todos(text: str | None) -> list[dict]:
    """To-do items of a model's answer: the whole, else its first object, else its first list; none if nothing can be read.
    Thoughts go first, also those that only close."""
    text = re.sub(r"(?s)<think>.*?(</think>|$)", "", text or "")
    text = text.split("</think>", 1)[-1].strip()
    fence = re.fullmatch(r"(?s)```(?:json)?(.*)```", text)
    text = fence[1].strip() if fence else text
    tries = [(text, (dict, list)), *((b, (dict,)) for b in balanced_blocks(text)[:1]), *((b, (list,)) for b in balanced_blocks(text, "[", "]")[:1])]
    return next((found for block, kinds in tries if (found := _todos(block, kinds)) is not None), [])


def recover_translations(text: str | None) -> list[dict] | None:
    """Translations (id, text) of a model's answer: of the last object that holds some, else the last list of them, so that an
    example which the model repeats first does not count; None without any. Only what follows the last thought is read."""
    text = (text or "").rsplit("</think>", 1)[-1].strip()
    text = re.sub(r"^```(?:json)?\s*", "", text)
    for opening, closing in ("{}", "[]"):
        for block in reversed(balanced_blocks(text, opening, closing)):
            try:
                value = json.loads(block)
            except (ValueError, RecursionError):
                continue
            rows = value.get("translations") if isinstance(value, dict) else value
            if isinstance(rows, list) and all(isinstance(r, dict) and isinstance(r.get("id"), str) and isinstance(r.get("text"), str) for r in rows):
                return [{"id": r["id"], "text": r["text"]} for r in rows]
    return None


def todos(column: Column) -> Column:
    """The items of each answer (title, description, priority, due_time, labels)."""
    names = ("title", "description", "priority", "due_time")

    @F.pandas_udf("array<struct<title:string,description:string,priority:string,due_time:string,labels:array<string>>>")
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{n: x.get(n) for n in names} | {"labels": x.get("labels", [])} for x in recover_todos(t)])

    return items(column)


def translations(column: Column) -> Column:
    """The translations of each answer (id, text); null for an answer without any."""

    @F.pandas_udf("array<struct<id:string,text:string>>")
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(recover_translations)

    return items(column)


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__p = 1").drop("__p")
