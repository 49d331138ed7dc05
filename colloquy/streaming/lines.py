"""Lines of a running transcript and who spoke them, when lines and speakers come in either order.

Events of a session (seq, at_ms, kind, id, text, start_ms, end_ms, speaker_id) are partial or final
lines and the speakers of spans of time. A speaker's span names every line without one whose
midpoint it holds; a span that holds none waits, and names the first final line that fits it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import meaningful
from colloquy.streaming.folds import _folded, _streamed

#: How long a span waits, and how many wait at once (the newest).
WAIT_MS, MOST_WAITING = 30_000, 64

_MADE = "seq long, change string, id string, text string, start_ms long, end_ms long, speaker_id string, resolved boolean"
_SPANS = "array<struct<at: long, lo: long, hi: long, speaker: string>>"
_OPEN = "array<struct<id: string, text: string, start_ms: long, end_ms: long>>"
_STATE = f"partial boolean, waiting {_SPANS}, open {_OPEN}"
_EMPTY = (False, [], [])


def _step(state: tuple, e: Any) -> tuple[tuple, list[dict]]:
    # waiting: (at, from, until, speaker) of spans; unnamed: (id, text, from, until) of lines
    partial, waiting, unnamed = bool(state[0]), [tuple(w) for w in state[1]], [tuple(u) for u in state[2]]

    def change(what: str, line: tuple, speaker: str | None, resolved: bool) -> dict:
        return dict(zip(("seq", "change", "id", "text", "start_ms", "end_ms", "speaker_id", "resolved"), (e.seq, what, *line, speaker, resolved), strict=True))

    def holds(lo: float, hi: float, line: tuple) -> bool:
        return 2 * lo <= line[2] + line[3] <= 2 * hi

    if e.kind == "speaker":
        named = [u for u in unnamed if holds(e.start_ms, e.end_ms, u)]
        if named:
            return (partial, waiting, [u for u in unnamed if u not in named]), [change("named", u, e.speaker_id, True) for u in named]
        fresh = [w for w in waiting if w[0] >= e.at_ms - WAIT_MS]
        return (partial, [*fresh, (e.at_ms, e.start_ms, e.end_ms, e.speaker_id)][-MOST_WAITING:], unnamed), []
    line = (e.id, e.text, int(e.start_ms or 0), int(e.end_ms or 0))
    if e.kind == "partial":
        return (True, waiting, unnamed), [change("partial", line, e.speaker_id, e.speaker_id is not None)]
    if not e.counts:
        return (False, waiting, unnamed), [change("cleared", (None,) * 4, None, False)] if partial else []
    waiting = [w for w in waiting if w[0] >= e.at_ms - WAIT_MS]
    unnamed = [u for u in unnamed if u[0] != e.id]
    speaker, resolved = e.speaker_id, e.speaker_id is not None
    fits = [] if resolved else [w for w in waiting if holds(w[1], w[2], line)][:1]
    for w in fits:
        waiting.remove(w)
        speaker, resolved = w[3], True
    return (False, waiting, unnamed if resolved else [*unnamed, line]), [change("line", line, speaker, resolved)]


def _ready(events: DataFrame) -> DataFrame:
    """Lines with text, spans with both ends, and whether a final line says anything."""
    whole = F.when(F.col("kind") == "speaker", F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).otherwise(F.coalesce(F.trim("text") != "", F.lit(False)))
    named = F.coalesce("id", F.concat(F.lit("local-"), F.col("seq").cast("string")))
    return events.where(whole).select("session_id", "seq", "at_ms", "kind", named.alias("id"), "text", "start_ms", "end_ms", "speaker_id", F.coalesce(meaningful(F.col("text")), F.lit(False)).alias("counts"))


def line_changes(events: DataFrame) -> DataFrame:
    """What each event changes: a partial line, a line (new or in place of one of its id), a line named, a partial cleared."""
    return _folded(_ready(events), ["seq"], _step, _EMPTY, _MADE)


def stream_line_changes(events: DataFrame) -> DataFrame:
    """The same over a stream whose batches come in the order of seq."""
    return _streamed(_ready(events), ["seq"], _step, _EMPTY, _MADE, _STATE)


def lines(changes: DataFrame) -> DataFrame:
    """Each final line as its last change left it."""
    rows = changes.where("change IN ('line', 'named')").groupBy("session_id", "id")
    last = rows.agg(F.max_by(F.struct("text", "start_ms", "end_ms", "speaker_id", "resolved"), "seq").alias("l"))
    return last.select("session_id", "id", "l.*")
