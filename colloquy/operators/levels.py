"""Smoothed loudness of sessions and its reports, as scans over blocks of time.

A session may be long; its chunks are dealt by session and block. Only one summary a block meets those of the same session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is kept of the level before, and the least time between two reports.
KEPT, EVERY_MS = 0.7, 66
#: Chunks of one scaled sum: 0.7 to this power is far from the smallest double.
RUN = 256
#: 0.7 to this power is less than the smallest double, so that nothing from before it can count.
REACH = 2_100


def _block(block_ms: int) -> Column:
    return F.floor(F.col("at_ms") / block_ms)


def smoothed(chunks: DataFrame, block_ms: int = 5_000) -> DataFrame:
    """chunks (session_id, at_ms, seq, rms) with level = 0.7 * level before + 0.3 * rms, from 0, in the order of at_ms and seq.

    A run is up to 256 chunks of a block. Within a run the level from 0 is one sum of scaled values; what came before is the
    sum of the last levels of earlier runs, each times 0.7 to the number of chunks since. Chunks whose rms is null had no
    samples; they are left out, as they neither change nor report a level.
    """
    block = ["session_id", "__block"]
    run = [*block, "__run"]
    ordered = Window.partitionBy(*block).orderBy("at_ms", "seq")
    placed = chunks.where("rms IS NOT NULL").withColumn("__block", _block(block_ms)).withColumn("__n", F.row_number().over(ordered))
    placed = placed.withColumns({"__run": F.floor((F.col("__n") - 1) / RUN), "__n": (F.col("__n") - 1) % RUN + 1})
    within = Window.partitionBy(*run).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__local", F.sum((1 - KEPT) * F.col("rms") / F.pow(F.lit(KEPT), "__n")).over(within) * F.pow(F.lit(KEPT), "__n"))

    ends = local.groupBy(*run).agg(F.max("__n").alias("n"), F.max_by("__local", "__n").alias("last"))
    in_session = Window.partitionBy("session_id").orderBy("__block", "__run")
    ends = ends.withColumn("end", F.sum("n").over(in_session.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.collect_list(F.struct("end", "last")).over(Window.partitionBy("session_id").orderBy("end").rangeBetween(-REACH, -1))
    start = F.col("end") - F.col("n")
    carried = ends.select(*run, F.aggregate(before, F.lit(0.0), lambda s, e: s + e["last"] * F.pow(F.lit(KEPT), start - e["end"])).alias("__carry"))
    level = F.col("__local") + F.col("__carry") * F.pow(F.lit(KEPT), "__n")
    return local.join(carried, run).select(*chunks.columns, level.alias("level"))


def _walk(times: np.ndarray, first: int, every: int) -> list[int]:
    """The reported times from first on: each is the first at least so long after the one before."""
    out, at = [], int(np.searchsorted(times, first))
    while at < len(times):
        out.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + every))
    return out


def reported(levels: DataFrame, every_ms: int = EVERY_MS, block_ms: int = 5_000) -> DataFrame:
    """The rows of levels (session_id, at_ms, seq, ...) that are passed on: a session's first, then always the first row
    at least every_ms after the one passed on before.

    Where the walk enters a block depends on its last report before it, which lies less than every_ms back or does not
    matter. So each block tells for each of its possible entries where the walk leaves it; a session's blocks are then chained, and
    each block is walked from its true entry.
    """
    kind = dict(levels.dtypes)["session_id"]
    times = levels.select("session_id", _block(block_ms).alias("__block"), F.col("at_ms").cast("long").alias("at_ms")).distinct()

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["at_ms"].to_numpy())
        late = int(np.searchsorted(at, int(pdf["__block"].iloc[0]) * block_ms + every_ms))
        entries = at[: late + 1]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "__block": pdf["__block"].iloc[0], "entry": entries, "last": [_walk(at, e, every_ms)[-1] for e in entries]})

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__block", "entry"])
        keep, last, done = [], None, None
        for k, (block, entry, leaves) in enumerate(zip(pdf["__block"], pdf["entry"], pdf["last"], strict=True)):
            if block != done and (last is None or entry >= last + every_ms):
                keep.append(k)
                last, done = leaves, block
        return pdf.iloc[keep][["session_id", "__block", "entry"]]

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        at = _walk(np.sort(pdf["at_ms"].to_numpy()), int(pdf["entry"].iloc[0]), every_ms)
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "at_ms": at})

    block = ["session_id", "__block"]
    ways = times.groupBy(*block).applyInPandas(exits, f"session_id {kind}, __block long, entry long, last long")
    entries = ways.groupBy("session_id").applyInPandas(chained, f"session_id {kind}, __block long, entry long")
    chosen = times.join(entries, block).groupBy(*block).applyInPandas(walked, f"session_id {kind}, at_ms long")
    first = Window.partitionBy("session_id", "at_ms").orderBy("seq")
    single = levels.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    return single.join(chosen, ["session_id", "at_ms"], "left_semi").select(*levels.columns)
