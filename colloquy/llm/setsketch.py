"""Near copies by SetSketch registers.

Every register holds the smallest of exponentially distributed hash values of a set's elements, on
an exponential scale and truncated. Equal registers are as likely as the sets are alike, so bands of
registers are index keys; the largest of two registers is the register of the union. A pair that
shares a band is judged by the likelihood of its registers, jointly with both set sizes, and confirmed
on the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bucket_links import Groups, Marks, link
from colloquy.llm.common import cut, mix64, quoted, slices, spare
from colloquy.llm.ngram_join import SKETCH as PARITY_WORDS
from colloquy.llm.ngram_join import Likeness, _Codes, fingerprints, shingles, verified
from colloquy.llm.ngram_join import sketch as parities

#: Registers (a prime, so that any step visits all of them) and how many make a band. Two sets at the limit
#: of 0.8 miss all 42 bands with a chance of (1 - 0.8**5)**42 = 6e-8.
REGISTERS, BAND = 211, 5
BANDS = REGISTERS // BAND
#: Base and rate of the scale, and its largest value (registers have 16 bits).
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
#: A pair whose registers are exp(-CHANCE) as likely at the limit as at their best estimate is ruled out: below it,
#: that many standard deviations squared over two, here six.
CHANCE = 18.0
#: A short form of the registers, two hashed bits of each, in so many 64-bit words, rules out pairs inside the joins.
#: Unequal registers differ in it three times of four; pairs at the limit differ in 66 or more of 211 with a chance of 2e-9.
SHORT_WORDS, MOST_UNEQUAL = 7, 65
#: Points drawn at one time.
_DRAWN = 4096

#: Which registers a band takes: mixed, so that no element's walk over the registers fits the bands.
_ORDER = np.argsort(mix64(np.arange(REGISTERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")[: BANDS * BAND].reshape(BANDS, BAND)
_STEP_SALT, _POINT_SALT, _BAND_SALT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit codes (unsigned 16 bits each); all 0 for the empty set.

    An element's values come in ascending order, as gaps between the order statistics of REGISTERS
    exponential variables, and fall on the registers in an order of the element's own. So an element
    is done with when its next value is above all registers.
    """
    least = np.full(REGISTERS, np.inf)
    seed = mix64(elements ^ _STEP_SALT)
    start = (seed % np.uint64(REGISTERS)).astype(np.int64)
    step = ((seed >> np.uint64(16)) % np.uint64(REGISTERS - 1)).astype(np.int64) + 1
    value, codes, done = np.zeros(len(elements)), elements, 0
    while done < REGISTERS and len(codes):
        more = min(max(_DRAWN // len(codes), 1), REGISTERS - done)
        at = np.arange(done, done + more)
        drawn = mix64(codes[:, None] + (at.astype(np.uint64) + np.uint64(1)) * _POINT_SALT)
        gap = -np.log1p(-((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        values = value[:, None] + np.cumsum(gap / (REGISTERS - at), axis=1)
        np.minimum.at(least, ((start[:, None] + at * step[:, None]) % REGISTERS).ravel(), values.ravel())
        value = values[:, -1]
        on = value <= least.max()
        value, codes, start, step, done = value[on], codes[on], start[on], step[on], done + more
    if not len(elements):
        return np.zeros(REGISTERS, dtype=np.uint16)
    return np.clip(np.floor(1 - np.log(np.maximum(least / RATE, 1e-300)) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band's registers."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND_SALT
    for k in range(BAND):
        total = mix64(total ^ sketch[_ORDER[:, k]].astype(np.uint64)) + np.uint64(k)
    return total


def short_form(sketch: np.ndarray) -> np.ndarray:
    """Two bits of a hash of each register, 32 registers in a word; signed, and 0 where there is no register."""
    bits = np.zeros(32 * SHORT_WORDS, dtype=np.uint64)
    bits[:REGISTERS] = mix64(sketch.astype(np.uint64) * _STEP_SALT + np.arange(REGISTERS, dtype=np.uint64)) & np.uint64(3)
    words = bits.reshape(SHORT_WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(words, axis=1).view(np.int64)


def _chance(x: np.ndarray) -> np.ndarray:
    """p_b of the sketch's theory: chance that one set's register is above the other's, from the share x of
    the union that only the first has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Logarithm of the likelihood of similarity j for numbers of registers of the first set above and below
    those of the second, where u is the first size's share of both sizes."""
    p, q = _chance(np.maximum(u - (1 - u) * j, 0)), _chance(np.maximum((1 - u) - u * j, 0))
    log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0)
    return log(above, p) + log(below, q) + log(REGISTERS - above - below, 1 - p - q)


def estimate(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of the greatest likelihood of pairs of sets of n and m elements; the likelihood is
    concave, so that the golden section finds its top."""
    u = n / (n + m)
    lo, hi = np.zeros(len(u)), np.minimum(n, m) / np.maximum(n, m)
    part = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        x, y = hi - part * (hi - lo), lo + part * (hi - lo)
        left = _likelihood(x, above, below, u) >= _likelihood(y, above, below, u)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def likely(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether registers and sizes leave room for a similarity of percent or more."""
    u, limit = n / (n + m), percent / 100
    best = estimate(above, below, n, m)
    loss = _likelihood(best, above, below, u) - _likelihood(np.full(len(u), limit), above, below, u)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & ((best >= limit) | (loss <= CHANCE))


def _prepared(rows: DataFrame, like: Likeness, seed: int) -> DataFrame:
    """rows (id, digest, text) with a number of their own, set size, fingerprints and registers in place of the text."""
    kind, shorts = dict(rows.dtypes)["id"], _shorts()

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = _Codes(), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            sets = [shingles((t or "").encode("utf-8"), like.words, codes, seed) for t in batch.column(2).to_pylist()]
            row = np.arange(number, number + len(sets))
            number += len(sets)
            marks = [fingerprints(s) if len(s) else (None, None) for s in sets]
            sketches = [registers(s) for s in sets]
            short = np.array([[*short_form(x), *parities(s)] for x, s in zip(sketches, sets, strict=True)], dtype=np.int64).reshape(-1, SHORT_WORDS + PARITY_WORDS)
            columns = [batch.column(0), batch.column(1), pa.array(row), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, short.T.copy())], names=["id", "digest", "row", "n", "node", "check", "sketch", *shorts])

    return rows.mapInArrow(prepared, f"id {kind}, digest binary, row long, n long, node long, check long, sketch binary, {', '.join(f'{c} long' for c in shorts)}")


def _shorts() -> list[str]:
    """Columns of the short form and, after them, of the set's parities (see ngram_join.sketch)."""
    return [f"s{k}" for k in range(SHORT_WORDS + PARITY_WORDS)]


def _entries(nodes: DataFrame) -> DataFrame:
    """point and key of every band of every node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keys = [band_keys(np.frombuffer(s, dtype=np.uint16)) for s in batch.column(1).to_pylist()]
            points = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.concatenate(keys).view(np.int64))], names=["point", "key"])

    return nodes.select("node", "sketch").mapInArrow(rows, "point long, key long")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers leave room for a link."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            sizes = [batch.column(k).to_numpy().astype(float) for k in (2, 3)]
            on = likely((x > y).sum(axis=1), (x < y).sum(axis=1), *sizes, percent)
            yield batch.select(["a", "b"]).filter(pa.array(on))

    return joined.mapInArrow(rows, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) and kept (id = component_id) for every row.

    Texts are linked if their sets of word n-grams are similar by percent or more. Links are confirmed
    on the words; that a linked pair shares no band has a chance of 6e-8 at 80 percent, less above, and
    more below (at 70 percent 4e-4), so percent has to be 80 or more.
    Null texts are empty: no shingles, linked with nothing (component_id is the own id, kept). Equal sets
    count as one node; repeated rows are in one group and stay together; a null id takes part, names no
    group that has another, and is kept only if its group has none. Very long texts are read whole; no columns but
    these two are read.
    """
    if percent < 80:
        raise ValueError("bands are laid out for similarities of 80 percent or more")
    found = _grouped(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), Likeness(words, percent))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(rows: DataFrame, like: Likeness) -> DataFrame:
    """id, digest, n_shingles and component_id for every row (id, text)."""
    rows, seed = rows.select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text"), 0
    while True:
        prepared = cut(_prepared(rows, like, seed))
        # of rows with equal sets the one with the smallest id (a null id last) stands for the set
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")).alias("first")
        chosen = cut(prepared.where("node IS NOT NULL").groupBy("node").agg(first, F.min("check").alias("lo"), F.max("check").alias("hi")))
        if chosen.where("lo <> hi").isEmpty():
            break
        seed += 1  # two sets share a fingerprint: others are drawn
    one = chosen.select("node", "first.id", "first.digest", "first.row")
    nodes = cut(prepared.select("row", "n", "sketch", *_shorts()).join(one.select("node", "row"), "row").drop("row"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(_plausible(pairs, nodes, like.percent))
        wanted = one.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        match = wanted.select("node", F.col("id").alias("first_id"), "digest")
        texts = rows.join(match, "digest").where(F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])
        return verified(pairs, cut(texts), like)

    groups = Groups(verify)
    link(_entries(nodes), Marks(nodes.select(F.col("node").alias("point"), "node", "n", *_shorts()), ["n", *_shorts()], _near(like.percent)), groups)
    roots = groups.rooted(prepared.select("id", "digest", "n", "node"), "node")
    component = roots.where("node_root IS NOT NULL").groupBy("node_root").agg(F.min("id").alias("component"))
    return roots.join(component, "node_root", "left").select("id", "digest", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _near(percent: int) -> Callable[[list[str], list[str]], Column]:
    """What sizes, short forms and parities of two linked sets fulfil. Sets of n and m elements that differ in d have
    n + m + d in union and n + m - d in intersection, both twice; parities differ in d places at most."""

    def near(here: list[str], there: list[str]) -> Column:
        n, m = F.col(here[0]), F.col(there[0])
        bits = [F.col(a).bitwiseXOR(F.col(b)) for a, b in zip(here[1:], there[1:], strict=True)]
        unequal = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in bits[:SHORT_WORDS]), F.lit(0))
        differ = sum((F.bit_count(x) for x in bits[SHORT_WORDS:]), F.lit(0)).cast("long")
        few = differ * (100 + percent) <= (n + m) * (100 - percent)
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & few & (unequal <= MOST_UNEQUAL)

    return near


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the rows whose id names it, all columns unchanged.

    Rows that repeat the same id and text stay together; an id with several texts is judged text by
    text; rows with a null id stay; null and empty texts stay; long texts are compared whole. Columns of
    docs may have any names; an empty table stays empty.
    """
    own = spare(docs.columns)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    gone = cut(_grouped(rows, Likeness(words, percent)).where("id <> component_id").select(F.col("id").alias(f"{own}id"), F.col("digest").alias(f"{own}digest")).distinct())
    digest = F.unhex(F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256))
    return docs.join(gone, (F.col(quoted(id_col)) == F.col(f"{own}id")) & (digest == F.col(f"{own}digest")), "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
