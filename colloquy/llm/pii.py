"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits,
schemes and cues of identifiers and keys. At each anchor a local parser with fixed rules expands to both sides
and validates what it found, so text without anchors costs nothing more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import quoted, slices, texts_of

#: Kinds in the order in which spans at the same place are listed: base kinds, then added ones.
KINDS = ("email", "ip", "card", "phone", "account", "address", "secret")
BASE = KINDS[:4]

#: Cues of account identifiers, of postal addresses and of keys.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
ADDRESS_CUES = ("street", "avenue", "road", "boulevard", "straße", "strasse", "rue ", "calle ")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "bearer")
SCHEMES = ("://", "mailto:", "acct:", "tel:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PROFILE = re.compile(r"://[A-Za-z0-9.-]+/(?:~|@|u/|user/|users/|in/|profile/)[A-Za-z0-9._-]+")
_HANDLE = re.compile(r"(?:acct|tel):\+?[A-Za-z0-9._-]+")
_AFTER_CUE = re.compile(r"(?:[\x20]?(?:no\.?|number|nr\.?))?[\x20]?[:#=]?[\x20]?([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}|[0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9])")
_HOUSE_BEFORE = re.compile(r"(?:^|(?<=\s))[0-9]{1,5}[a-z]?\x20(?:[A-ZÄÖÜ][\w.'-]*\x20){0,3}[\w'-]*$")
_HOUSE_AFTER = re.compile(r"(?:[\w'-]+\x20){0,4}[0-9]{1,5}[a-z]?(?!\w)")
_AFTER_SECRET = re.compile(r"(?:\x20?[:=]\x20?|\x20)([\"']?)([A-Za-z0-9+/_.~=-]{12,})\1")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_iban(code: str) -> bool:
    """Mod-97 test of an international account number."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("address", ADDRESS_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in {word, word.title(), word.upper()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def find_spans(text: str) -> list[Span]:
    """All spans of a text, by start and then kind. Spans of one kind don't overlap."""
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start

    def take(start: int, end: int, kind: str, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            out.append(Span(start, end, kind))

    for last, (anchor, length) in anchors().iter(text):
        at = last + 1 - length
        if anchor == "digit":
            if at >= free["ip"]:
                if m := _IP.match(text, at):
                    take(at, m.end(), "ip", all(map(part_fits, m[0].split("."))))
                else:
                    free["ip"] = _RUN.match(text, at).end()
            if at >= free["card"]:
                if m := _CARD.match(text, at):
                    digits = m[0].replace(" ", "").replace("-", "")
                    take(at, m.end(), "card", 14 <= len(digits) <= 19 and passes_luhn(digits))
                else:
                    free["card"] = at + 1
        elif anchor == "at":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                take(start, m.end(), "email")
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                take(at, m.end(), "phone", 10 <= sum(map(str.isdigit, m[0])) <= 15)
        elif at < free.get(anchor if anchor != "scheme" else "account", 0):
            continue
        elif anchor == "scheme":
            if m := _PROFILE.match(text, at) or _HANDLE.match(text, at):
                start = at
                while m[0][0] == ":" and start > free["account"] and text[start - 1].isalpha():
                    start -= 1
                take(start, m.end(), "account")
        elif anchor == "account":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _AFTER_CUE.match(text, last + 1)):
                code = m[1]
                take(m.start(1), m.end(1), "account", not code[0].isalpha() or is_iban(code))
        elif anchor == "secret":
            if (m := _AFTER_SECRET.match(text, last + 1)) and any(map(str.isdigit, m[2])):
                take(m.start(2), m.end(2), "secret")
        elif anchor == "address":
            if text[last] == " ":
                m = _HOUSE_AFTER.match(text, last + 1)
                start, end = (at, m.end()) if m and (at == 0 or not text[at - 1].isalnum()) else (0, 0)
            else:
                low = at
                for _ in range(5):  # the house number and up to four words
                    low = max(text.rfind(" ", free["address"], max(low, free["address"])), text.rfind("\n", free["address"], max(low, free["address"])))
                low = max(low, free["address"])
                m = _HOUSE_BEFORE.search(text[low:at])
                after = last + 1 == len(text) or not text[last + 1].isalnum()
                start, end = (low + m.start(), last + 1) if m and after else (0, 0)
            if end:
                take(start, end, "address")
    out.sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, found (array of start, end, kind; code points, end exclusive) and base_sha256, the
    digest of the base kinds.

    A null text is empty and has no spans; very long texts are read whole in one pass; repeated
    rows are treated one by one; further columns of the input are not read.
    """
    chosen = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)))
    schema = f"{quoted(id_col)} {dict(chosen.dtypes)[id_col]}, found array<struct<start: int, end: int, kind: string>>, base_sha256 string, spans string"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find_spans(t) for t in texts_of(batch.column(1))]
            digests = [hashlib.sha256(listed([s for s in x if s.kind in BASE]).encode()).hexdigest() for x in found]
            rows = pa.array([[s._asdict() for s in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(digests, pa.string()), pa.array([listed(x) for x in found], pa.string())], names=[id_col, "found", "base_sha256", "spans"])

    return chosen.mapInArrow(spotted, schema)


def counted(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of spans by kind beside the digests."""
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col(quoted(id_col)), *(n(k).alias(f"n_{k}") for k in KINDS), F.size("found").cast("long").alias("n_all"), "base_sha256", "spans")
