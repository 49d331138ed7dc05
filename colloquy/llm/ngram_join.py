"""Jaccard join of word n-gram sets by partition of the universe.

Sizes fall into bands. For the pairs whose smaller set lies in a band, the sets can differ in at
most k elements, so if the universe of elements is hashed into segments of total weight k + 1 or
more (a segment of weight 1 has to agree, one of weight 2 may differ in one element), two similar
sets agree on one segment. Sets are indexed by what they have in each segment, segments of weight
2 also with each single element left out. A cost model chooses how many segments get weight 2.
Candidates that share an index entry are verified by their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bucket_links import Groups, Marks, link
from colloquy.llm.common import cut, cut_alone, mix64, quoted, slices, spare

#: Cost model: chance that an unrelated set has an element's place filled alike, sets met.
ALIKE, MET = 0.05, 1e5
CACHE_WORDS = 300_000
#: 64-bit words of a set's parity sketch.
SKETCH = 8

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 60)))])


@dataclass(frozen=True)
class Likeness:
    """Word n-grams of this many words; similar if 100 * intersection >= percent * union."""

    words: int
    percent: int

    def differing(self, size: int) -> int:
        """Elements in which a set and a set of at least its size can differ."""
        return size * (100 - self.percent) // self.percent

    def partner(self, size: int) -> int:
        """Size of the largest similar set."""
        return size * 100 // self.percent


@lru_cache(64)
def _bounds(percent: int) -> np.ndarray:
    """Least sizes of the bands; a set and its partners lie in one band or in two neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out)


@lru_cache(4096)
def allocate(k: int, size: int) -> tuple[int, int]:
    """Numbers of segments of weight 1 and 2 for pairs that differ in k elements at most.

    The costs of a choice are its index entries and the unrelated sets met. Segments beyond the weight
    of k + 1 cost no entries: each set leaves out as many of its emptiest segments of weight 1, in
    which unrelated sets meet most; but they make all segments emptier.
    """
    need, best = k + 1, (np.inf, k + 1, 0)
    double = np.arange(need // 2 + need % 2 + 1)
    elements = np.arange(60)[:, None]
    for more in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4):
        base = np.maximum(need - 2 * double, 0)
        single = base + np.ceil(base * more)
        filled = 0.9 * size / (single + double)  # a band's sets are a little smaller than its largest
        chance = np.exp(elements * np.log(filled) - filled - _LOG_FACTORIAL[:60, None])
        left_out = np.where(single > 0, (single - base) / np.maximum(single, 1), 0)
        kept = np.clip(np.cumsum(chance, axis=0) - left_out, 0, chance)
        met = single * (kept * ALIKE**elements).sum(axis=0) + double * (1 + filled) * np.exp(-filled * (1 - ALIKE)) / ALIKE
        cost = base + double * (1 + filled) + MET * met
        at = int(np.argmin(cost))
        if cost[at] < best[0]:
            best = (float(cost[at]), int(single[at]), int(double[at]))
    return best[1], best[2]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: bytes, words: int, codes: _Codes, seed: int = 0) -> np.ndarray:
    """Sorted different shingles of a text as 64-bit codes. A-Z are lower-cased; words stand
    between ASCII white space; fewer words than a shingle has are one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    code = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    total = np.full(n, (seed * 2 + 1) * 1_000_003 + width, dtype=np.uint64)
    for k in range(width):
        total = (total + code[k : k + n]) * _ODD[k % len(_ODD)]
    return np.unique(mix64(total))


def fingerprints(elements: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit values that depend on the set alone."""
    a = mix64(elements ^ _ODD[0]).sum(dtype=np.uint64)
    b = mix64(elements + _ODD[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(elements: np.ndarray) -> list[int]:
    """Parities of a set's elements in 64 * SKETCH places. Two sets' sketches differ in no more
    places than the sets differ in elements."""
    place = (mix64(elements + _ODD[4]) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def index_keys(elements: np.ndarray, like: Likeness) -> np.ndarray:
    """Index entries of a set, for its own band and as the larger partner in the band below."""
    bounds, size = _bounds(like.percent), len(elements)
    band = int(np.searchsorted(bounds, size, side="right")) - 1
    out = []
    for group in (band, band - 1):
        if group < 0:
            continue
        most = int(bounds[group + 1]) - 1
        k = like.differing(most)
        if k == 0 or size > like.partner(most):
            continue
        single, double = allocate(k, most)
        m = single + double
        segment = ((elements >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        value = mix64(elements * _ODD[2])
        total = np.zeros(m, dtype=np.uint64)
        np.add.at(total, segment, value)
        salt = mix64((np.arange(m, dtype=np.uint64) * _ODD[3] + np.uint64(group)) * _ODD[4])
        key = mix64(total ^ salt)
        # the emptiest segments of weight 1 are left out, in an order of their contents alone: of two sets the one that
        # goes further leaves out all that the other does, and one segment on which they agree remains
        count = np.bincount(segment, minlength=m)[double:]
        order = np.lexsort((key[double:], count)) + double
        out += [key[:double], key[order[single + 2 * double - (k + 1) :]]]
        if double:
            at = segment < double
            seg = segment[at]
            out.append(mix64((total[seg] - value[at]) ^ salt[seg]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _prepared(rows: DataFrame, like: Likeness, seed: int) -> DataFrame:
    """rows (id, digest, text) with a number of their own, set size, fingerprints, sketch (s0, s1, ...) and
    index entries in place of the text."""
    kind = dict(rows.dtypes)["id"]
    names = [f"s{k}" for k in range(SKETCH)]

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = _Codes(), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            sets = [shingles((t or "").encode("utf-8"), like.words, codes, seed) for t in batch.column(2).to_pylist()]
            row = np.arange(number, number + len(sets))
            number += len(sets)
            marks = [fingerprints(s) if len(s) else (None, None) for s in sets]
            sketches = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, SKETCH)
            keys = [index_keys(s, like).view(np.int64) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(row), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sketches.T.copy()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "row", "n", "node", "check", *names, "keys"])

    return rows.mapInArrow(prepared, f"id {kind}, digest binary, row long, n long, node long, check long, {', '.join(f'{c} long' for c in names)}, keys array<bigint>")


def _near(like: Likeness) -> tuple[list[str], Callable[[list[str], list[str]], Column]]:
    """Marks that rule out a link: sets that differ in d elements have n + m + d elements in union
    and n + m - d in intersection, both twice, and d is at least what sizes and sketches differ in."""

    def near(here: list[str], there: list[str]) -> Column:
        n, m = F.col(here[0]), F.col(there[0])
        differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(here[1:], there[1:], strict=True)), F.lit(0))
        return F.greatest(differ.cast("long"), F.abs(n - m)) * (100 + like.percent) <= (n + m) * (100 - like.percent)

    return ["n", *[f"s{k}" for k in range(SKETCH)]], near


class _Numbers(dict):
    """Word to a number of its own."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def whole_shingles(tokens: list[np.ndarray], words: int) -> list[np.ndarray]:
    """The different shingles of texts given as word numbers: equal numbers stand for equal shingles,
    across the texts too. A text of fewer words is one shingle, filled up with a number of no word."""
    bits = int(max(max(t.max() for t in tokens), sum(map(len, tokens)))).bit_length() + 1
    width = [min(words, len(t)) for t in tokens]
    at = [t[: len(t) - w + 1] for t, w in zip(tokens, width, strict=True)]
    filled = 1
    for k in range(1, words):
        if (filled + 1) * bits > 62:
            _, again = np.unique(np.concatenate(at), return_inverse=True)
            at, filled = np.split(again.astype(np.int64), np.cumsum([len(a) for a in at])[:-1]), 1
        at = [(a << bits) | (t[k : k + len(a)] if w > k else (1 << bits) - 1) for a, t, w in zip(at, tokens, width, strict=True)]
        filled += 1
    return [np.unique(a) for a in at]


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """a, b and linked for pairs (a, b), from the words of both texts (texts: node, text)."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            linked = []
            seen, numbers = {}, _Numbers()
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(numbers) > 1 << 18:
                    seen, numbers = {}, _Numbers()
                for node, text in ((a, x), (b, y)):
                    if node not in seen:
                        seen[node] = np.array([numbers[w] for w in text.encode("utf-8").lower().split()], dtype=np.int64)
                p, q = whole_shingles([seen[a], seen[b]], like.words)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= like.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return joined.mapInArrow(rows, "a long, b long, linked boolean")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) for every row.

    Null texts are empty: no shingles, linked with nothing (component_id is the own id). Equal sets
    count as one node; repeated rows are in one group; a null id takes part like any other and is
    no component_id unless its whole group has none. Very long texts have more shingles and more
    index entries in proportion. The index and the counts use 64-bit codes of shingles, links are
    confirmed on the words. No columns but these two are read.
    """
    found = _grouped(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), Likeness(words, percent))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _grouped(rows: DataFrame, like: Likeness) -> DataFrame:
    """id, digest, n_shingles and component_id for every row (id, text)."""
    rows, seed = rows.select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text"), 0
    names, near = _near(like)
    while True:
        prepared = cut(_prepared(rows, like, seed))
        # of rows with equal sets the one with the smallest id (a null id last) stands for the set
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")).alias("first")
        nodes = cut(prepared.where("node IS NOT NULL").groupBy("node").agg(first, F.min("check").alias("lo"), F.max("check").alias("hi"), *[F.first(c).alias(c) for c in names]))
        if nodes.where("lo <> hi").isEmpty():
            break
        seed += 1  # two sets share a fingerprint: others are drawn
    one = nodes.select("node", "first.id", "first.digest", "first.row")
    entries = prepared.select("node", "row", "keys").join(one.select("node", "row"), ["node", "row"]).select(F.col("node").alias("point"), F.explode("keys").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = one.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        match = wanted.select("node", F.col("id").alias("first_id"), "digest")
        texts = rows.join(match, "digest").where(F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])
        return verified(pairs, cut(texts), like)

    groups = Groups(verify)
    link(entries, Marks(nodes.select(F.col("node").alias("point"), "node", *names), names, near), groups)
    roots = groups.rooted(prepared.select("id", "digest", "n", "node"), "node")
    component = roots.where("node_root IS NOT NULL").groupBy("node_root").agg(F.min("id").alias("component"))
    return roots.join(component, "node_root", "left").select("id", "digest", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group the rows whose id names it, all columns unchanged.

    Rows that repeat the same id and text stay together; an id with several texts is judged text by
    text; rows with a null id stay; empty texts stay. Columns of docs may have any names.
    """
    own = spare(docs.columns)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    gone = cut_alone(lambda: _grouped(rows, Likeness(words, percent)).where("id <> component_id").select(F.col("id").alias(f"{own}id"), F.col("digest").alias(f"{own}digest")).distinct())
    digest = F.unhex(F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256))
    return docs.join(gone, (F.col(quoted(id_col)) == F.col(f"{own}id")) & (digest == F.col(f"{own}digest")), "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
