"""Clips as they are recorded: segments gathered until silence, length or mute closes the clip, and its manifest.

One step function runs in batch and in Structured Streaming. Silence needs no event of its own: the
time at which it would close the clip is known after each segment. In batch the next event tells
whether that time passed in silence, in a stream an event-time timer fires at it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.config import DEFAULTS, Settings
from colloquy.sources.manifests import SEGMENTS
from colloquy.streaming.folds import _folded
from colloquy.streaming.voices import in_order

_MADE = f"clip_id string, started_at_ms long, ended_at_ms long, closed_at_ms long, segments {SEGMENTS}"
_NAMES = ["session_id", "clip_id", "started_at_ms", "ended_at_ms", "closed_at_ms", "segments"]


class Tape(NamedTuple):
    """An open clip (began_ms None: there is none), when speech last ended, and its segments (id, start_ms, end_ms)."""

    began_ms: int | None = None
    spoken_ms: int | None = None
    segments: tuple[tuple[int, int, int], ...] = ()

    def silent_at(self, settings: Settings) -> int | None:
        """When the clip closes if nothing more is heard."""
        if self.began_ms is None:
            return None
        return min(self.began_ms + settings.clip_max_ms, max(self.began_ms + settings.clip_target_ms, self.spoken_ms + settings.silence_close_ms))


def close(tape: Tape, session: Any, at_ms: int) -> dict:
    """The manifest of a clip that is closed."""
    listed = [{"id": i, "start_ms": a, "end_ms": b, "file": f"seg_{k + 1:04}.wav"} for k, (i, a, b) in enumerate(tape.segments)]
    return {"clip_id": f"{session}-{tape.began_ms}", "started_at_ms": tape.began_ms, "ended_at_ms": tape.segments[-1][2], "closed_at_ms": at_ms, "segments": listed}


def record(tape: Tape, e: Any, settings: Settings) -> tuple[Tape, list[dict]]:
    """The next state after an event (session_id, id, kind, start_ms, end_ms, archived), and the manifests of clips it closes.

    Speech is gathered unless the session is private (not archived); it closes the clip at its longest length. A
    mute closes the clip, in private too. Any event shows that the silence before it has passed.
    """
    out = []
    silent = tape.silent_at(settings)
    if silent is not None and silent <= e.start_ms:
        out.append(close(tape, e.session_id, silent))
        tape = Tape()
    if e.kind == "speech" and e.archived:
        began = e.start_ms if tape.began_ms is None else tape.began_ms
        tape = Tape(began, e.end_ms, (*tape.segments, (e.id, e.start_ms, e.end_ms)))
        if e.end_ms - began >= settings.clip_max_ms:
            out.append(close(tape, e.session_id, e.end_ms))
            tape = Tape()
    elif e.kind == "mute" and tape.began_ms is not None:
        out.append(close(tape, e.session_id, e.start_ms))
        tape = Tape()
    return tape, out


def _events(events: DataFrame) -> DataFrame:
    known = events.where("kind IN ('speech', 'mute') AND start_ms IS NOT NULL AND (kind = 'mute' OR end_ms IS NOT NULL)")
    return known.select("session_id", "id", "kind", "start_ms", "end_ms", F.coalesce("archived", F.lit(True)).alias("archived"))


def clip_manifests(events: DataFrame, until_ms: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Manifests (session_id, clip_id, started_at_ms, ended_at_ms, closed_at_ms, segments) of all clips that are closed by
    until_ms. events: session_id, id, kind (speech, mute), start_ms, end_ms, archived (null counts as true)."""

    def step(state: tuple, e: Any) -> tuple[tuple, list[dict]]:
        tape, made = record(Tape(*state), e, settings)
        return tape, made

    rows = _events(events)
    ends = rows.select("session_id").distinct().select("session_id", F.lit(None).cast("long").alias("id"), F.lit("until").alias("kind"), F.lit(until_ms).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(True).alias("archived"))
    return _folded(rows.where(F.col("start_ms") <= until_ms).unionByName(ends), ["start_ms", "id"], step, Tape(), _MADE)


class _Recorder(StatefulProcessor):
    """The open clip of a session: its times, its segments as a list, and a timer. All three go when the clip closes."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "began_ms long, spoken_ms long, timer_ms long")
        self.segments = handle.getListState("segments", "id long, start_ms long, end_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tape, timer = Tape(), None
        if self.open.exists():
            began, spoken, timer = self.open.get()
            tape = Tape(began, spoken, tuple(tuple(s) for s in self.segments.get()))
        before, out = tape, []
        for e in in_order(rows, ["start_ms", "id"]):
            tape, made = record(tape, e, self.settings)
            out += [{"session_id": key[0], **m} for m in made]
        self._keep(before, tape, timer)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out, at = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.open.exists():
            began, spoken, timer = self.open.get()
            if timer == at:
                tape = Tape(began, spoken, tuple(tuple(s) for s in self.segments.get()))
                out.append({"session_id": key[0], **close(tape, key[0], at)})
                self._keep(tape, Tape(), None)
        yield pd.DataFrame(out, columns=_NAMES)

    def _keep(self, before: Tape, tape: Tape, timer: int | None) -> None:
        silent = tape.silent_at(self.settings)
        if timer is not None and timer != silent:
            self.handle.deleteTimer(timer)
        if silent is None:
            self.open.clear()
            self.segments.clear()
            return
        if timer != silent:
            self.handle.registerTimer(silent)
        self.open.update((tape.began_ms, tape.spoken_ms, silent))
        if before.began_ms == tape.began_ms and before.segments == tape.segments[: len(before.segments)]:
            more = tape.segments[len(before.segments) :]
        else:
            self.segments.clear()
            more = tape.segments
        if more:
            self.segments.appendList(list(more))

    def close(self) -> None:
        pass


def stream_clip_manifests(events: DataFrame, late: str = "30 seconds", settings: Settings = DEFAULTS) -> DataFrame:
    """The same over a stream; times are milliseconds since 1970. A clip that silence closes comes once the watermark
    (late behind the latest event of any session) is past that time; events that are later than that are lost."""
    timed = _events(events).withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)
    kind = dict(events.dtypes)["session_id"]
    return timed.groupBy("session_id").transformWithStateInPandas(_Recorder(settings), f"session_id {kind}, {_MADE}", "append", "eventTime")
