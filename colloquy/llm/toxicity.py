"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words and word beginnings. Each term has a linear
weight and a short vector; the product of two terms' vectors is the weight of their appearing
together, so an insult beside a group's name can count for more than both alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, held_out_column, quoted, slices, spare, starts_of, texts_of
from colloquy.llm.labelled import MAX_FIT_ROWS, sample_ids

#: Hash buckets, vector length, and the beginnings of a word that are terms beside the word.
BUCKETS, FACTORS, BEGINNINGS = 1 << 20, 4, (4, 5, 6)
#: A term takes part if so many of the sample's documents, and such a share of them, have it: a bound
#: of the fit that looks at no label.
MIN_DOCUMENTS, MIN_SHARE = 4, 0.002
#: Words that a worker remembers.
CACHE_WORDS = 50_000

_WORDS = re.compile(r"[^\W\d_]+")


def buckets_of(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(f) % BUCKETS for f in (word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k))]


class _Terms(dict):
    """Word to its buckets."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = buckets_of(word)
        return out


def term_buckets(text: str, terms: _Terms) -> np.ndarray:
    """The different buckets of a text, in order."""
    words = set(_WORDS.findall(text.lower()))
    return np.unique(np.fromiter((b for w in words for b in terms[w]), dtype=np.int64))


@dataclass
class FactorizationMachine:
    """active: the buckets that take part, sorted; the other arrays have a row for each."""

    active: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score_rows(self, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Probabilities; row k has the active terms index[offsets[k]:offsets[k + 1]]."""
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        n = len(offsets) - 1
        linear = np.bincount(rows, self.weight[index], n)
        pairs = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[index, f]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * pairs, -30, 30)))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: int, epochs: int = 12, rate: float = 0.03, errors: float = 2.0, pair_errors: float = 8.0, start: float = 0.02, steps: int = 1000, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, minibatches, Adam. rows have numbers of terms below terms.

    After each step weights and whole vectors shrink by a constant, so that those end at zero which the
    labels move by less than so many standard errors (errors for weights; vectors shrink far less).
    Vectors start away from zero, so that terms which tell something only together are found: no term is
    ruled out for what it tells alone. The epoch counts that does best on a tenth of the rows.
    """
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        p = 0.5 if n == 0 else (labels.sum() + 1) / (n + 2)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    order, base = rng.permutation(n), float(labels.mean())
    held = order[: n // 10] if n >= 500 else order
    used = order[len(held) if n >= 500 else 0 :]
    weight, factor, bias = np.zeros(terms), rng.normal(0, start, (terms, FACTORS)), float(np.log(base / (1 - base)))
    first, second, step = np.zeros((terms, FACTORS + 1)), np.zeros((terms, FACTORS + 1)), 0
    size = max(16, min(256, n // 16))
    epochs = max(epochs, -(-steps * size // n))  # small samples need more of them

    def flat(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return starts_of(np.array([len(rows[k]) for k in batch])), np.concatenate([rows[k] for k in batch]).astype(np.int64)

    parts = max(1, len(used) // size)
    shrink, pair_shrink = rate * min(0.8, errors / parts**0.5), rate * min(0.8, pair_errors / n**0.5)
    best, found = np.inf, None
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), parts):
            offsets, ix = flat(batch)
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            v = factor[ix]
            sums = np.stack([np.bincount(row, v[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(row, (v**2).sum(1), len(batch))
            logit = bias + np.bincount(row, weight[ix], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            pull = error[row][:, None] * (sums[row] - v)
            grad = np.stack([np.bincount(ix, error[row], terms), *[np.bincount(ix, pull[:, f], terms) for f in range(FACTORS)]], axis=1)
            step += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
            weight, factor, bias = weight - move[:, 0], factor - move[:, 1:], bias - 0.3 * float(error.sum())
            weight = np.sign(weight) * np.maximum(np.abs(weight) - shrink, 0)
            length = np.sqrt((factor**2).sum(1, keepdims=True))
            factor = factor * (np.maximum(length - pair_shrink, 0) / np.maximum(length, 1e-12))
        machine = FactorizationMachine(np.arange(terms), bias, weight, factor)
        p = np.clip(machine.score_rows(*flat(held)), 1e-6, 1 - 1e-6)
        loss = -float(np.where(labels[held] == 1, np.log(p), np.log(1 - p)).mean())
        if loss < best:
            best, found = loss, machine
    on = (found.weight != 0) | (found.factor != 0).any(axis=1)
    return FactorizationMachine(np.flatnonzero(on), found.bias, found.weight[on], found.factor[on])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (3, 1), max_rows: int = MAX_FIT_ROWS) -> FactorizationMachine:
    """Fits on at most max_rows labelled rows outside the held-out remainder (held_out: divisor and
    remainder of crc32 of the id). Without any usable row the machine scores 0.5 everywhere.

    Terms are counted in the tasks; the driver gets the numbers of those that enough of the sampled
    documents have, and no text.
    """
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"))
    ids = docs.sparkSession.createDataFrame(sample_ids(known, "label", "id", held_out_column("id", *held_out), max_rows).collect(), f"id {dict(known.dtypes)['id']}, __label int")
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(ids), "id")
    sample = cut(texts.dropDuplicates(["id"]))
    least = max(MIN_DOCUMENTS, int(np.ceil(MIN_SHARE * sample.count())))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen = _Terms(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for t in texts_of(batch.column(0)):
                seen[term_buckets(t, terms)] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    counts = sample.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    active = np.array(sorted(r[0] for r in counts.where(F.col("n") >= least).select("bucket").collect()), dtype=np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in slices(batches):
            rows = []
            for t in texts_of(batch.column(0)):
                found = term_buckets(t, terms)
                at = np.searchsorted(active, found)
                rows.append(at[(at < len(active)) & (active[np.minimum(at, len(active) - 1)] == found)] if len(active) else at[:0])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary()), batch.column(1), batch.column(2)], names=["b", "y", "k"])

    found = sample.select("text", "__label", "id").mapInArrow(numbered, f"b binary, y int, k {dict(known.dtypes)['id']}").collect()
    found.sort(key=lambda r: r.k)
    machine = fit_machine([np.frombuffer(r.b, np.int32) for r in found], np.array([r.y for r in found], dtype=np.int64), len(active))
    machine.active = active[machine.active]
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """keep's columns (the id unless given) and the score, between 0 and 1, under the given name.

    Null and empty texts have no terms and get the bias's score; very long texts are read whole;
    repeated rows are scored one by one. The machine that is broadcast has at most BUCKETS terms.
    """
    keep = keep or [id_col]
    inner = [f"c{k}" for k in range(len(keep))]
    chosen = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(keep, inner, strict=True)], F.col(quoted(text_col)).alias("text"))
    kinds = dict(chosen.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        number = {int(b): k for k, b in enumerate(fm.active)}
        known = _Known(number)
        for batch in slices(batches):
            rows = []
            for t in texts_of(batch.column(len(keep))):
                found: set[int] = set()
                found.update(*map(known.__getitem__, set(_WORDS.findall(t.lower()))))
                rows.append(np.fromiter(found, np.int64, len(found)))
            index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fm.score_rows(starts_of(np.array([len(r) for r in rows])), index))], names=[*inner, "score"])

    out = chosen.mapInArrow(scored, ", ".join(f"{k} {kinds[k]}" for k in inner) + ", score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], F.round("score", 9).alias(name))


class _Known(dict):
    """Word to the numbers of its active terms."""

    def __init__(self, number: dict[int, int]):
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = tuple(self.number[b] for b in buckets_of(word) if b in self.number)
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1), threshold: float = 0.7, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """id, held_out, score and predicted (score at or above threshold) for every row of docs."""
    machine = train(docs, labels, id_col, text_col, "toxic", held_out, max_rows)
    found = score(docs, machine, id_col, text_col)
    return found.select(F.col(quoted(id_col)), held_out_column(quoted(id_col), *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, max_rows: int = MAX_FIT_ROWS, fit_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score below threshold, all columns unchanged. fit_docs: where the
    labelled rows' texts are, docs unless given.

    Null and empty texts get the bias's score; repeated rows go or stay together; an empty table stays
    empty; columns of docs may have any names.
    """
    machine = train(docs if fit_docs is None else fit_docs, labels, id_col, text_col, max_rows=max_rows)
    name = f"{spare(docs.columns)}score"
    return score(docs, machine, id_col, text_col, docs.columns, name).where(F.col(name) < threshold).drop(name)
