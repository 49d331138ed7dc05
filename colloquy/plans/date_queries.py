"""Times that texts name, over a grid of phrases and moments, and the same rules in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import dates

#: What the events say: each names a day in one of these ways and a time in one of the others.
DAYS = (
    "day after tomorrow", "tomorrow", "tonight", "Today", "this evening", "this weekend", "next week", "next month", "end of month", "EOM", "end of week", "eow",
    "end of day", "eod", "next Monday", "on mon,", "tues", "tue,", "Wednesday", "this thu", "thu,", "Fri", "sat,", "sunday", "大后天", "后天", "明天", "今天", "今晚",
    "5月18日", "12月3", "13月1日", "May 18th", "december 3rd", "feb 29", "Feb 30", "mar", "5/18", "05/18/2026", "13/5/6", "2/30", "99999999999/5/6", "2026-05-18",
    "in an hour", "in 1 week", "in 20 min", "in 3 hours", "in 2days", "in 5 weeks", "in 7 moons", "yesterday", "yesterdays", "昨天", "",
)
TIMES = ("", "", "at 10", "at 10am", "at 3:30pm", "at 15:00", "at 24", "at 12 a.m.", "3pm", "12:05am", "7:75pm", "noon", "midnight", "morning", "afternoon", "evening", "look at me, 9pm", "at 9:1:5")
_N = len(DAYS)


def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """What each event asks for, as seen from a moment of its own, which its id moves through more than a year."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    pick = lambda words, place: F.element_at(F.array(*map(F.lit, words)), (place + 1).cast("int"))
    phrase = F.concat(pick(DAYS, F.col("event_id") % _N), F.lit(" "), pick(TIMES, F.floor(F.col("event_id") / _N) % len(TIMES)))
    now = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 401).cast("int"))
    return rows.select("event_id", F.substring(dates.resolved(phrase, now).cast("string"), 1, 16).alias("due"))


QUERIES = {f.__name__: f for f in (relative_dates,)}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(words: tuple[str, ...], text: str = "l") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _date(year: str, month: str, day: str) -> str:
    return f"TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', CAST({year} AS BIGINT), TRY_CAST({month} AS BIGINT), TRY_CAST({day} AS BIGINT)) AS DATE)"


def _next(weekday: int) -> str:
    """The next such day, strictly after today (0 is Monday)."""
    return f"(today + CAST(({weekday} - isodow(today) + 7) % 7 + 1 AS INTEGER))"


def _month_rule(name: str, month: int) -> str:
    day = f"nullif(regexp_extract(l[strpos(l, '{name}') + {len(name)}:], '^\\s*([0-9]+)', 1), '')"
    this, following = (_date(f"year(today) + {k}", str(month), day) for k in (0, 1))
    return f"CASE WHEN contains(l, '{name}') THEN CASE WHEN {this} < today THEN coalesce({following}, {this}) ELSE {this} END END"


_WEEKDAY_ORDER = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_PHRASES = (
    (("day after tomorrow",), "today + 2"), (("tomorrow",), "today + 1"), (("tonight", "today", "this evening"), "today"), (("this weekend",), _next(5)),
    (("next week",), f"{_next(0)} + 7"), (("next month",), "last_day(today) + 1"), (("end of month", "eom"), "last_day(today)"), (("end of week", "eow"), _next(4)),
    (("end of day", "eod"), "today"),
)
_DAY = "coalesce(" + ",\n".join(
    [f"CASE WHEN {_any(words)} THEN {day} END" for words, day in _PHRASES]
    + [f"CASE WHEN contains(l || ' ', '{name}') THEN {_next(_WEEKDAY_ORDER.index(day))} END" for name, day in dates.WEEKDAYS]
    + [f"CASE WHEN contains(t, '{word}') THEN today + {days} END" for word, days in (("大后天", 3), ("后天", 2), ("明天", 1), ("今天", 0), ("今晚", 0))]
    + [_date("year(today)", "nullif(regexp_extract(split_part(t, '月', 1), '([0-9]+)$', 1), '')", "nullif(regexp_extract(split_part(t, '月', 2), '^([0-9]+)', 1), '')")]
    + [_month_rule(name, month) for name, month in dates.MONTHS]
    + ["slashed", f"CASE WHEN regexp_full_match(trim(l), '[0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN {_date(*[f'split_part(trim(l), chr(45), {k})' for k in (1, 2, 3)])} END"]
) + ")"
_SLASHED = f"""SELECT event_id, found AS slashed FROM (SELECT event_id, k, m >= 4294967296 OR d >= 4294967296 AS ends, {_date("y", "m", "d")} AS found FROM (
    SELECT event_id, k, today, TRY_CAST(nullif(regexp_extract(p[k], '([0-9]+)$', 1), '') AS BIGINT) AS m, TRY_CAST(nullif(regexp_extract(p[k + 1], '^([0-9]+)', 1), '') AS BIGINT) AS d,
        coalesce(CASE WHEN regexp_full_match(p[k + 1], '[0-9]+') THEN TRY_CAST(nullif(regexp_extract(p[k + 2], '^([0-9]+)', 1), '') AS INTEGER) END, year(today)) AS y
    FROM (SELECT event_id, today, string_split(l, '/') AS p, unnest(generate_series(1, len(string_split(l, '/')) - 1)) AS k FROM said)) WHERE m IS NOT NULL AND d IS NOT NULL) WHERE ends OR found IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k) = 1"""
_SPAN = (
    "coalesce(CASE WHEN contains(l, 'in an hour') OR contains(l, 'in 1 hour') THEN 60 WHEN contains(l, 'in a week') OR contains(l, 'in 1 week') THEN 10080 END, "
    "CASE WHEN contains(l, 'in ') THEN TRY_CAST(nullif(regexp_extract(spanned, '^([0-9]+)', 1), '') AS BIGINT) * CASE regexp_extract(spanned, '^[0-9]+\\s*(min|hour|day|week)', 1) WHEN 'min' THEN 1 WHEN 'hour' THEN 60 WHEN 'day' THEN 1440 WHEN 'week' THEN 10080 END END)"
)
_CLOCK = """CASE WHEN contains(l, 'noon') THEN 720 WHEN contains(l, 'midnight') THEN 0 WHEN contains(l, 'morning') THEN 540 WHEN contains(l, 'evening') AND NOT contains(l, 'this evening') THEN 1080
    WHEN h < 24 AND m < 60 THEN CAST(60 * CASE WHEN half = 'p' AND h < 12 THEN h + 12 WHEN half = 'a' AND h = 12 THEN 0 ELSE h END + m AS INTEGER) END"""

ORACLE_SQL = {
    "relative_dates": f"""WITH said AS (SELECT *, lower(t) AS l, CAST(now AS DATE) AS today FROM (SELECT event_id, date_trunc('second', ts) + to_days(CAST(event_id % 401 AS INTEGER)) AS now,
        {_list(DAYS)}[event_id % {_N} + 1] || ' ' || {_list(TIMES)}[event_id // {_N} % {len(TIMES)} + 1] AS t FROM events)),
    slashes AS ({_SLASHED}),
    clocks AS (SELECT *, TRY_CAST(nullif(regexp_extract(c, '^([0-9]+)', 1), '') AS BIGINT) AS h, coalesce(TRY_CAST(nullif(replace(regexp_extract(c, '^[0-9]*(:[0-9:]*)', 1), ':', ''), '') AS BIGINT), 0) AS m,
        regexp_extract(c, '^[0-9:]*\\s*([ap])\\.?m', 1) AS half FROM (SELECT *, l[strpos(l, 'in ') + 3:] AS spanned,
        trim(CASE WHEN contains(l, 'at ') THEN l[strpos(l, 'at ') + 3:] ELSE regexp_extract(l, '[0-9][0-9:]*(am|pm|a\\.m|p\\.m)') END) AS c FROM said)),
    read AS (SELECT event_id, now, today, t, l, {_DAY} AS day, {_SPAN} AS span, {_CLOCK} AS clock FROM clocks LEFT JOIN slashes USING (event_id)),
    due AS (SELECT event_id, CASE WHEN regexp_matches(l, '(^|[^a-z])yesterday($|[^a-z])') OR contains(t, '昨天') THEN NULL
        WHEN span IS NOT NULL THEN CASE WHEN clock IS NULL THEN now + to_minutes(span) ELSE CAST(CAST(now + to_minutes(span) AS DATE) AS TIMESTAMP) + to_minutes(clock) END
        WHEN day IS NOT NULL THEN CAST(day AS TIMESTAMP) + to_minutes(coalesce(clock, CASE WHEN {_any(("tonight", "this evening"))} THEN 1200 WHEN {_any(("end of day", "eod"))} THEN 1020 ELSE 540 END))
        WHEN CAST(today AS TIMESTAMP) + to_minutes(clock) <= now THEN CAST(today + 1 AS TIMESTAMP) + to_minutes(clock) ELSE CAST(today AS TIMESTAMP) + to_minutes(clock) END AS moment FROM read)
    SELECT event_id, strftime(moment, '%Y-%m-%d %H:%M') AS due FROM due""",
}
