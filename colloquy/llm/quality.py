"""Quality by positive-unlabelled learning.

Trusted good texts and unlabelled web text are told apart by minimising the non-negative unbiased
risk: the unlabelled risk less the share that the positives explain, never taken below zero. The
class prior is estimated from the two samples before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import held_out_column, mix64, slices
from colloquy.llm.labelled import MAX_FIT_ROWS, collect_sample, sample_ids, smallest_ids

#: Words of a window whose shares are looked at one by one.
WINDOW = 40

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SIGN, _BAR, _WIDE = range(8)


def _byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8 text; all bytes beyond ASCII are letters of words."""
    out = np.full(256, _SIGN, dtype=np.int64)
    out[97:123], out[65:91], out[48:58] = _LOWER, _UPPER, _DIGIT
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[ord(c) for c in ".,;:'\"-?"]] = _STOP
    out[ord("|")], out[128:] = _BAR, _WIDE
    return out


_CLASS = _byte_classes()
_CODE = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(20)).astype(np.int64)
FEATURES = 22


def features(texts: list[bytes]) -> np.ndarray:
    """One row for each text: shares of byte classes, of kinds of words, and the greatest shares
    within a window of words. All of it is counted for the texts together."""
    out = np.zeros((len(texts), FEATURES))
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return out
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = _CLASS[data]
    blank = kind == _SPACE
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return out
    text_of = np.searchsorted(ends, begins, side="right")
    stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    length = stops - begins
    n = np.bincount(text_of, minlength=len(texts)).astype(float)
    some = np.maximum(n, 1)
    total = np.maximum(np.bincount(text_of, length, len(texts)), 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[stops] - c[begins]

    upper, lower, digit, sign, bar, stop, wide = (per_word(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _SIGN, _BAR, _STOP, _WIDE))
    for k, count in enumerate((upper, lower, digit, sign, bar, stop, wide)):
        out[:, k] = np.bincount(text_of, count, len(texts)) / total
    code = np.concatenate([[0], np.cumsum(_CODE[data])])
    code = (code[stops] - code[begins]) * 31 + length
    again = np.zeros(len(begins))
    again[1:] = (code[1:] == code[:-1]) & (text_of[1:] == text_of[:-1])
    shout = ((upper >= 2) & (lower == 0)).astype(float)
    noisy = (sign > 0).astype(float)
    barred = (bar > 0).astype(float)
    odd = ((digit > 0) | (length > 24)).astype(float)
    single = (length - stop <= 1).astype(float)
    flags = np.stack([again, shout, noisy, barred, odd, single], axis=1)
    first = np.searchsorted(text_of, np.arange(len(texts)))
    within = np.arange(len(begins)) - first[text_of]
    window = within // WINDOW
    fresh = np.flatnonzero((within % WINDOW) == 0)
    sums = np.add.reduceat(flags, fresh, axis=0)
    size = np.diff(np.append(fresh, len(begins)))
    shares = sums / np.maximum(size, 8)[:, None]
    owner = text_of[fresh]
    for k in range(flags.shape[1]):
        out[:, 7 + k] = np.bincount(text_of, flags[:, k], len(texts)) / some
        np.maximum.at(out[:, 13 + k], owner, shares[:, k])
    out[:, 19] = np.log1p(n) / 10
    out[:, 20] = np.minimum(np.bincount(text_of, length, len(texts)) / some / 10, 5)
    bad = (shares[:, :4].max(axis=1) > 0.5).astype(float)
    out[:, 21] = np.bincount(owner, bad, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    del window
    return out


@dataclass
class QualityNet:
    """A small network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _net(x: np.ndarray, hidden: int, seed: int) -> QualityNet:
    rng = np.random.default_rng(seed)
    return QualityNet(x.mean(0), x.std(0) + 1e-3, rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, 0.5)


def _descend(net: QualityNet, batches, gradient_of, epochs: int, rate: float) -> None:
    """Adam over the network's parameters; gradient_of gives rows and the loss's slope in logits."""
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in names}
    second = {k: v.copy() for k, v in first.items()}
    step = 0
    for _ in range(epochs):
        for batch in batches():
            x, slope = gradient_of(*batch)
            z = np.clip((x - net.mean) / net.scale, -8, 8)
            h = np.tanh(z @ net.w1 + net.b1)
            back = slope[:, None] * net.w2 * (1 - h * h)
            grads = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": h.T @ slope + 1e-4 * net.w2, "b2": slope.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - move)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """Share of positives among the unlabelled. A network tells the two samples apart; for any
    region of scores the unlabelled mass over the positive mass bounds the prior from above, and
    the least bound over the regions that hold a tenth of the positives or more is taken."""
    x = np.vstack([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    weight = np.where(y == 1, 0.5 / len(positive), 0.5 / len(unlabelled)) * len(x)
    net, rng = _net(x, 8, seed), np.random.default_rng(seed)
    batches = lambda: ((b,) for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)))
    _descend(net, batches, lambda b: (x[b], weight[b] * (_sigmoid(net.logits(x[b])) - y[b]) / len(b)), 20, 0.01)
    p, u = np.sort(net.logits(positive)), np.sort(net.logits(unlabelled))
    cuts = np.quantile(p, np.linspace(0, 0.9, 46))
    above = lambda s, c: 1 - np.searchsorted(s, c) / len(s)
    bounds = [above(u, c) / above(p, c) for c in cuts]
    return float(np.clip(min(bounds), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 60, rate: float = 0.01, seed: int = 3) -> QualityNet:
    """Non-negative PU risk with the logistic loss. Where the estimated risk of the negatives falls
    below zero on a minibatch, the step goes up that part's slope instead."""
    if not len(positive) or not len(unlabelled):
        net = _net(np.zeros((1, FEATURES)), 4, seed)
        net.w2[:] = 0
        return net
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    net, rng = _net(unlabelled, 16, seed), np.random.default_rng(seed)
    parts = max(1, len(unlabelled) // 512)

    def batches():
        return zip(np.array_split(rng.permutation(len(positive)), parts), np.array_split(rng.permutation(len(unlabelled)), parts), strict=True)

    def gradient(p: np.ndarray, u: np.ndarray):
        x = np.vstack([positive[p], unlabelled[u]])
        f = net.logits(x)
        fp, fu = f[: len(p)], f[len(p) :]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rise = np.concatenate([-prior * _sigmoid(fp) / max(len(p), 1), _sigmoid(fu) / len(u)])
        if negative < 0:
            return x, -rise
        rise[: len(p)] -= prior * _sigmoid(-fp) / max(len(p), 1)
        return x, rise

    _descend(net, batches, gradient, epochs, rate)
    net.prior = prior
    return net


def _featurised(texts: DataFrame, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features([(t or "").encode("utf-8") for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "k"])

    id_col = next(c for c in texts.columns if c not in (text_col, "__label"))
    return texts.select(text_col, id_col).mapInArrow(rows, f"x binary, k {dict(texts.dtypes)[id_col]}")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (4, 2), max_rows: int = MAX_FIT_ROWS) -> QualityNet:
    """Fits on at most max_rows trusted positives (label 1) and as many unlabelled documents, all
    outside the held-out remainder; labels 0 are never read. Without either the score is 0.5."""
    out = held_out_column(id_col, *held_out)
    trusted = sample_ids(labels, label_col, id_col, out, max_rows, F.col(label_col) == 1)
    web = smallest_ids(docs.where(F.col(id_col).isNotNull() & ~out).select(id_col), id_col, max_rows).withColumn("__label", F.lit(0))
    samples = []
    for ids in (trusted, web):
        rows = sorted(collect_sample(docs, ids, id_col, text_col, lambda t: _featurised(t, text_col)), key=lambda r: r.k)
        samples.append(np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, FEATURES))
    return fit(*samples)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2), threshold: float = 0.7, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """id, held_out, score and predicted (score at or above threshold) for every row of docs.

    Null texts are empty; an empty text has all shares zero and gets the score of that row of
    features; very long texts are read whole; repeated rows are scored one by one.
    """
    net = train(docs, labels, id_col, text_col, "quality", held_out, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    chosen = docs.select(id_col, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features([(t or "").encode("utf-8") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], names=[id_col, "score"])

    scores = chosen.mapInArrow(scored, f"{id_col} {dict(chosen.dtypes)[id_col]}, score double")
    return scores.select(id_col, held_out_column(id_col, *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
