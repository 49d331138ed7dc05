"""Times that a text names relative to now, in English and partly in Chinese: rules as data, compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.times import once

#: What names a weekday, in the order in which they are tried.
WEEKDAYS = (
    ("monday", "Mon"), ("mon ", "Mon"), ("mon,", "Mon"), ("tuesday", "Tue"), ("tues", "Tue"), ("tue ", "Tue"), ("wednesday", "Wed"), ("wed ", "Wed"), ("wed,", "Wed"),
    ("thursday", "Thu"), ("thurs", "Thu"), ("thu ", "Thu"), ("friday", "Fri"), ("fri ", "Fri"), ("fri,", "Fri"), ("saturday", "Sat"), ("sat ", "Sat"), ("sat,", "Sat"),
    ("sunday", "Sun"), ("sun ", "Sun"), ("sun,", "Sun"),
)
#: Month names in the order in which they are tried.
MONTHS = (
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11),
    ("december", 12), ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("oct", 10), ("nov", 11), ("dec", 12),
)
#: Phrases for a day, the first that fits counts, and the day that each means.
DAY_PHRASES: tuple[tuple[tuple[str, ...], Callable[[Column], Column]], ...] = (
    (("day after tomorrow",), lambda today: F.date_add(today, 2)),
    (("tomorrow",), lambda today: F.date_add(today, 1)),
    (("tonight", "today", "this evening"), lambda today: today),
    (("this weekend",), lambda today: F.next_day(today, "Sat")),
    (("next week",), lambda today: F.date_add(F.next_day(today, "Mon"), 7)),
    (("next month",), lambda today: F.date_add(F.last_day(today), 1)),
    (("end of month", "eom"), lambda today: F.last_day(today)),
    (("end of week", "eow"), lambda today: F.next_day(today, "Fri")),
    (("end of day", "eod"), lambda today: today),
)
CHINESE_DAYS = (("大后天", 3), ("后天", 2), ("明天", 1), ("今天", 0), ("今晚", 0))
#: Parts of a day with their hours; "this evening" is a day, not a time.
PARTS_OF_DAY = (("noon", 12), ("midnight", 0), ("morning", 9), ("afternoon", 14))
#: Minutes of the units of a span, in the order in which they are tried.
UNITS = (("min", 1), ("hour", 60), ("day", 1440), ("week", 10080))
SPANS = ((("in an hour", "in 1 hour"), 60), (("in a week", "in 1 week"), 10080))
#: Spans over this many minutes (7,600 years) have no time.
MAX_SPAN = 4_000_000_000
#: Numbers from here on are no numbers of a date or a time.
TOO_LARGE = 2**32
_BLANK = r"[\p{IsWhite_Space}]*"


def _says(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def _after(text: Column, word: str) -> Column:
    """What follows the first such word; null without one."""
    return once(F.locate(word, text), lambda at: F.when(at > 0, F.substring(text, at + len(word), F.length(text))))


def _number(digits: Column) -> Column:
    """Null for no digits and for too many."""
    return once(digits.try_cast("bigint"), lambda number: F.when(number < TOO_LARGE, number))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day in the years 1 to 9999."""
    zero = F.lit(0)

    def made(d: Column) -> Column:
        fits = d["month"].between(1, 12) & d["day"].between(1, 31) & d["year"].between(1, 9999)
        return F.when(fits, F.try_make_timestamp_ntz(d["year"].cast("int"), d["month"].cast("int"), d["day"].cast("int"), zero, zero, zero).cast("date"))

    return once(F.struct(year.alias("year"), month.alias("month"), day.alias("day")), made)


def _first(choices: list[Column]) -> Column:
    return F.coalesce(*choices)


def _chinese_date(text: Column, today: Column) -> Column:
    """Month and day around the first sign for month."""
    form = r"(?s)^[^月]*?([0-9]+)月([0-9]+)"
    return F.when(text.contains("月"), _date(F.year(today), *[_number(F.regexp_extract(text, form, g)) for g in (1, 2)]))


def _english_date(lower: Column, today: Column) -> Column:
    """A month's name and a day, of next year if it is over; only the first place of each name counts."""

    def named(name: str, month: int) -> Column:
        day = _number(F.regexp_extract(_after(lower, name), f"^{_BLANK}([0-9]+)", 1))

        def next_such(day: Column) -> Column:
            this, following = (_date(F.year(today) + k, F.lit(month), day) for k in (0, 1))
            return once(this, lambda this: F.when(this < today, F.coalesce(following, this)).otherwise(this))

        return once(day, next_such)

    return _first([F.when(lower.contains(name), named(name, month)) for name, month in MONTHS])


def _slash_date(lower: Column, today: Column) -> Column:
    """The first slash with a day around it, or with a number that is too large, which ends the search."""
    form = F.lit(r"([0-9]+)/(?=([0-9]+)(?:/([0-9]*))?)")
    groups = [F.regexp_extract_all(lower, form, F.lit(g)) for g in (1, 2, 3)]

    def read(x: Column) -> Column:
        month, day, year = (_number(x[str(k)]) for k in range(3))
        in_year = once(year, lambda year: F.when(year < 2**31, year).otherwise(F.year(today)))
        return F.struct(_date(in_year, month, day).alias("date"), (month.isNull() | day.isNull()).alias("ends"))

    found = F.filter(F.transform(F.arrays_zip(*[g.alias(str(k)) for k, g in enumerate(groups)]), read), lambda x: x["date"].isNotNull() | x["ends"])
    return F.when(lower.contains("/"), F.get(found, F.lit(0))["date"])


def _iso_date(lower: Column) -> Column:
    form = f"^{_BLANK}([0-9]{{1,4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_BLANK}$"
    return F.when(lower.contains("-"), _date(*[_number(F.regexp_extract(lower, form, g)) for g in (1, 2, 3)]))


def _day(text: Column, lower: Column, today: Column) -> Column:
    """The day that a text names, by the first rule that reads one."""
    phrases = [F.when(_says(lower, words), day(today)) for words, day in DAY_PHRASES]
    weekday = lambda padded: _first([F.when(padded.contains(name), F.next_day(today, day)) for name, day in WEEKDAYS])
    chinese = [F.when(text.contains(word), F.date_add(today, days)) for word, days in CHINESE_DAYS]
    return _first([*phrases, once(F.concat(lower, F.lit(" ")), weekday), *chinese, _chinese_date(text, today), _english_date(lower, today), _slash_date(lower, today), _iso_date(lower)])


def _span(lower: Column) -> Column:
    """Minutes from now of 'in N unit' at the first 'in '; null without one, negative if there are too many."""
    fixed = [F.when(_says(lower, words), F.lit(minutes).cast("bigint")) for words, minutes in SPANS]
    form = f"^([0-9]+){_BLANK}({'|'.join(name for name, _ in UNITS)})"

    def counted(said: Column) -> Column:
        number, unit = said["number"], said["unit"]
        return _first([F.when((unit == name) & number.isNotNull(), F.when(number <= MAX_SPAN // minutes, number * minutes).otherwise(F.lit(-1))) for name, minutes in UNITS])

    said = lambda after: F.struct(F.regexp_extract(after, form, 1).try_cast("bigint").alias("number"), F.regexp_extract(after, form, 2).alias("unit"))
    return _first([*fixed, F.when(lower.contains("in "), once(once(_after(lower, "in "), said), counted))])


def _clock(lower: Column) -> Column:
    """Minutes of the day of a named part of it, of what follows the first 'at ', or else of the first digits with am or pm."""
    parts = [F.when(lower.contains(word), F.lit(60 * hour)) for word, hour in PARTS_OF_DAY]
    evening = F.when(lower.contains("evening") & ~lower.contains("this evening"), F.lit(60 * 18))
    bare = F.regexp_extract(lower, r"[0-9][0-9:]*(?:am|pm|a\.m|p\.m)", 0)
    form = f"^{_BLANK}([0-9]*)((?::[0-9:]*)?){_BLANK}(am|pm|a\\.m|p\\.m)?"

    def read(said: Column) -> Column:
        minute = F.coalesce(_number(F.replace(F.regexp_extract(said, form, 2), F.lit(":"), F.lit(""))), F.lit(0))
        return F.struct(_number(F.regexp_extract(said, form, 1)).alias("hour"), F.substring(F.regexp_extract(said, form, 3), 1, 1).alias("half"), minute.alias("minute"))

    def whole(c: Column) -> Column:
        half, hour = c["half"], c["hour"]
        hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
        return once(hour, lambda hour: F.when((hour < 24) & (c["minute"] < 60), (hour * 60 + c["minute"]).cast("int")))

    return _first([*parts, evening, once(once(F.coalesce(_after(lower, "at "), bare), read), whole)])


def _at(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def _due(text: Column, lower: Column, now: Column) -> Column:
    rejected = lower.rlike("(?<![a-z])yesterday(?![a-z])") | text.contains("昨天")
    usual = F.when(_says(lower, ("tonight", "this evening")), 60 * 20).when(_says(lower, ("end of day", "eod")), 60 * 17).otherwise(60 * 9)

    def due(r: Column) -> Column:
        today, clock, span = r["today"], r["clock"], r["span"]
        later = F.when(span >= 0, now + F.make_dt_interval((span / 1440).cast("int"), F.lit(0), (span % 1440).cast("int")))
        spanned = F.when(clock.isNull(), later).otherwise(_at(later.cast("date"), clock))
        alone = once(_at(today, clock), lambda at: F.when(at <= now, _at(F.date_add(today, 1), clock)).otherwise(at))
        named = once(_day(text, lower, today), lambda day: F.coalesce(_at(day, F.coalesce(clock, usual)), alone))
        return F.when(span.isNotNull(), spanned).otherwise(named)

    read = F.struct(now.cast("date").alias("today"), _clock(lower).alias("clock"), _span(lower).alias("span"))
    return F.when(rejected, F.lit(None)).otherwise(once(read, due))


def resolved(column: Column, now: Column | datetime) -> Column:
    """The time that each text names, without a zone (timestamp_ntz), as seen from now (timestamp_ntz); null for the past
    ("yesterday"), for no time, for a null or empty text and for days and spans beyond the year 9999.

    A span from now beats a named day; a named time of day goes with either. A day without a time is at 9, this evening at
    20, its end at 17. A time alone is the next such time.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    # what a rule reads is worked out once, not once a rule
    given = once(F.struct(column.alias("text"), now.alias("now")), lambda r: F.struct(r["text"].alias("text"), F.lower(r["text"]).alias("lower"), r["now"].alias("now")))
    return once(given, lambda r: _due(r["text"], r["lower"], r["now"]))
