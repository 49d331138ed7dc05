"""Bounded samples for fitting classifiers, and how they are drawn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a fit reads at most; the sample is the rows with the smallest hashes of their ids.
MAX_FIT_ROWS = 12_000


def smallest_hashes(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most bound rows, the same ones on every run and for every order of the input."""
    return rows.orderBy(F.xxhash64(id_col), F.col(id_col)).limit(bound)


def sample_ids(labels: DataFrame, label_col: str, id_col: str, held_out: Column, bound: int, where: Column | None = None) -> DataFrame:
    """Ids and labels of the sample, one row for each id: null ids and labels and held-out rows
    are left out; of contradicting repeated labels the largest counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out)
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    return smallest_hashes(rows, id_col, bound)


def smallest_ids(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most bound different ids, those with the smallest hashes. Only rows below a hash bound, which is drawn
    wide enough to hold them, are made distinct: the ids of a large table are not shuffled."""
    n = rows.count()
    share = min(1.0, 4.0 * bound / max(n, 1))
    while True:
        few = rows.where(F.xxhash64(id_col) < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows
        out = smallest_hashes(few.select(id_col).distinct(), id_col, bound)
        if share >= 1 or out.count() == bound:
            return out
        share = min(1.0, 8 * share)  # many rows repeat their ids


def collect_sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, featurise: Callable[[DataFrame], DataFrame]) -> list:
    """Features of the sampled documents on the driver. ids has at most the sample's bound of rows
    (16 bytes each), which is why it may be broadcast."""
    known = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    texts = docs.select(id_col, text_col).join(F.broadcast(known), id_col).dropDuplicates([id_col])
    return featurise(texts).collect()
