"""Answers that ought to be JSON: as they are, out of a code fence, and repaired."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSING = {"{": "}", "[": "]"}
NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
LITERALS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null"}
QUOTES = {'"': '"', "'": "'", "“": "”"}
#: A quote ends its text if what follows can follow a text: a sign, the end, a new line, or the next text after white space.
ENDS = {q: re.compile(rf"\\.|{q}(?=\s*(?:[,:}}\]]|$)|[^\S\n]*\n|\s+[\"'“])", re.S) for q in QUOTES.values()}
BARE_KEY = re.compile(r"[^\s,:{}\[\]\"][^,:{}\[\]\"\n]*")
BARE_VALUE = re.compile(r"(?:(?!\s/[/*])[^,:{}\[\]\"\n]|:(?=[^\s,}\]]))+")
SKIPPED = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|$))+", re.S)
ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\(.?)|"', re.S)


def _text(raw: str) -> str:
    """The JSON text of what stood between quotes: escapes that JSON does not know lose their backslash."""
    fixed = ESCAPE.sub(lambda m: '\\"' if m[0] == '"' else m[0] if m[1] is None else m[1], raw)
    value = json.loads(f'"{fixed}"', strict=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return json.dumps(value, ensure_ascii=False)


def _bare(word: str) -> str | None:
    """The JSON text of a literal or number; null for other words."""
    return LITERALS.get(word) or (word if NUMBER.fullmatch(word) else None)


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The JSON text of the quoted text at a place, and where it ends; one that never closes goes to the end."""
    closing, begin = QUOTES[text[at]], at + 1
    for m in ENDS[closing].finditer(text, begin):
        if m[0][0] != "\\":
            return _text(text[begin : m.start()]), m.start() + 1
    return _text(text[begin:]), len(text)


def repaired_text(text: str | None) -> str | None:
    """The first object or list of a text as valid JSON; null without one.

    Brackets and quotes that are missing at the end are put there, missing and surplus commas are mended, single and curly
    quotes, bare keys and words, Python's literals, comments, quotes inside of texts and unknown escapes are read as they are
    meant. A closing bracket closes what was left open within, one that nothing opened is passed over. A key with a colon but
    no value has null; one without a colon goes. The stack holds open brackets only, so that depth is not limited.
    """
    begin = re.search(r"[{\[]", text or "")
    if not begin:
        return None
    at, out, stack, opened, key, colon = begin.start(), [], [], {"}": 0, "]": 0}, None, False

    def put(piece: str) -> None:
        nonlocal key, colon
        if stack:
            if stack[-1][1]:
                out.append(",")
            stack[-1][1] = True
            if stack[-1][0] == "}":
                out.append((key or '""') + ":")
        out.append(piece)
        key, colon = None, False

    def settle() -> None:
        nonlocal key
        if key is not None and colon:
            put("null")
        key = None

    def close() -> None:
        settle()
        closing = stack.pop()[0]
        opened[closing] -= 1
        out.append(closing)

    while at < len(text):
        skipped = SKIPPED.match(text, at)
        if skipped:
            at = skipped.end()
            continue
        c = text[at]
        if c == ",":
            settle()
            at += 1
        elif c == ":":
            colon, at = key is not None, at + 1
        elif c in CLOSING:
            put(c)
            stack.append([CLOSING[c], False])
            opened[CLOSING[c]] += 1
            at += 1
        elif c in opened:
            while opened[c]:
                done = stack[-1][0] == c
                close()
                if done:
                    break
            at += 1
            if not stack:
                break
        else:
            naming = stack[-1][0] == "}" and key is None
            if c in QUOTES:
                word, at = _quoted(text, at)
            else:
                m = (BARE_KEY if naming else BARE_VALUE).match(text, at)
                bare, at = (m[0].strip(), m.end()) if m else (c, at + 1)
                parts = [_bare(b) for b in bare.split()] if stack[-1][0] == "]" else []
                if len(parts) > 1 and all(parts):  # numbers and literals of a list without commas
                    for part in parts[:-1]:
                        put(part)
                    bare = bare.split()[-1]
                word = _text(bare) if naming else _bare(bare) or _text(bare)
            if naming:
                key = word
            else:
                put(word)
    while stack:
        close()
    return "".join(out)


def unfenced(column: Column) -> Column:
    """What stands within a code fence that encloses the whole text, else the text; trimmed."""
    text = F.regexp_replace(column, r"^\s+|\s+$", "")
    inner = F.regexp_extract(text, r"(?s)^```(?:json)?(.*)```$", 1)
    return F.when(inner != "", F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(text)


def broken(column: Column) -> Column:
    """The text that is to be repaired: null if Spark reads it as it is or out of its fence, so that it never gets to Python."""
    return F.when(F.try_parse_json(column).isNull() & F.try_parse_json(unfenced(column)).isNull(), unfenced(column))


def lenient(column: Column) -> Column:
    """A variant: the text as JSON, else what its fence holds, else what repair makes of it; null for a text with no object or
    list in it, and for null."""

    @F.pandas_udf("string")
    def mended(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_text, na_action="ignore")

    return F.coalesce(F.try_parse_json(column), F.try_parse_json(unfenced(column)), F.try_parse_json(mended(broken(column))))


def typed(column: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """The text as a struct of the schema; null if it cannot be read, is no object, or lacks a required field."""
    value = F.from_json(F.to_json(lenient(column)), schema)
    complete = value.isNotNull()
    for name in required:
        complete &= value[name].isNotNull()
    return F.when(complete, value)


def kind(column: Column) -> Column:
    """What kind of JSON a text is, in one word (object, array, string, number, boolean, null); null if it is none."""
    schema = F.schema_of_variant(F.try_parse_json(column))
    named = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
    return F.when(schema.isNotNull(), F.coalesce(named, F.lit("number")))
