"""URL filters: a trie over reversed host labels and path segments with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import quoted, slices

#: Entries of one broadcast trie; a longer list is judged in several passes, trie by trie.
MAX_RULES = 1_000_000

#: Fixed rules of the query: host, path, verdict.
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. The host stands after the first '://' and its A-Z are lower-cased; null or
    no '://' gives two empty strings."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    host = rest[:end].encode("utf-8").lower().decode("utf-8")
    return host, tail[:stop]


class RuleTrie:
    """Host labels from the right, then path segments from the left. A rule stands at the node of
    its last whole segment, with what its path has after the last slash kept as a string prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault(("host", label), {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            node.setdefault("rules", []).append((rest, rule))

    def find(self, host: str, path: str) -> Rule | None:
        """The fitting rule with the longest host and path together; on a tie the longer host."""
        best, best_key = None, (-1, -1)
        segments = path.split("/")
        node = self.root
        labels = list(reversed(host.split("."))) if host else []
        for depth in range(len(labels) + 1):
            if depth:
                node = node.get(("host", labels[depth - 1]))
                if node is None:
                    break
            at = node
            for k, segment in enumerate(segments):
                for rest, rule in at.get("rules", ()):
                    key = (len(rule.name), len(rule.host))
                    # the rule's remainder must open what is left of the path
                    if key > best_key and "/".join(segments[k:]).startswith(rest):
                        best, best_key = rule, key
                at = at.get(("path", segment))
                if at is None:
                    break
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every row: id, host, path, rule (null without one) and verdict.

    Null or malformed urls have an empty host and path and get the default verdict; repeated rows
    are judged one by one; further columns of the input are not read. Each broadcast trie holds at most
    MAX_RULES entries; of the passes' rules the longest counts, as within a trie.
    """
    known = [Rule(*x) for x in rules]
    tries = [RuleTrie(known[k : k + MAX_RULES]) for k in range(0, len(known), MAX_RULES)] or [RuleTrie([])]
    chosen = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"))
    parts = "host string, path string, rule string, verdict string, rule_host long"
    found = chosen.mapInArrow(_judge(pages, tries[0], False), f"id {dict(chosen.dtypes)['id']}, {parts}")
    for trie in tries[1:]:
        found = found.mapInArrow(_judge(pages, trie, True), found.schema)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _judge(pages: DataFrame, trie: RuleTrie, again: bool):
    """One pass over pages (id, url), or over the rows of a pass before."""
    shared = pages.sparkSession.sparkContext.broadcast(trie)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            rows = list(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)) if again else [split_url(u) for u in batch.column(1).to_pylist()]
            best = [(r.name, r.verdict, len(r.host)) if (r := shared.value.find(*x)) else (None, None, None) for x in rows]
            if again:
                before = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)
                best = [max(old, new, key=lambda b: (len(b[0]), b[2]) if b[0] is not None else (-1, -1)) for old, new in zip(before, best, strict=True)]
            columns = [[h for h, _ in rows], [p for _, p in rows], [b[0] for b in best], [b[1] for b in best]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array([b[2] for b in best], pa.int64())], names=["id", "host", "path", "rule", "verdict", "rule_host"])

    return judged
