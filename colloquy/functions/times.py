"""Times as texts: stored formats, due times and short forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often made names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def iso_millis(seconds: Column) -> Column:
    """Seconds of the epoch as ISO text with milliseconds in UTC."""
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plain(seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss")


def due_utc(column: Column, zone: str, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    """A local due time in UTC; null if no format reads it. Of two times with one name the earlier counts."""
    local = F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats])
    return F.date_format(F.to_utc_timestamp(local, zone), "yyyy-MM-dd HH:mm:ss")


def single_utc(local: Column, zone: str) -> Column:
    """The one instant at which clocks of a zone show a local time, in UTC; null if there are none or two, as when clocks are
    changed. The offsets of a day before and a day after are tried, each kept if it leads back to the local time."""
    day = F.expr("INTERVAL 1 DAY")

    def tried(t: Column, at: Column) -> Column:
        """t by the offset at an instant, if clocks then show t."""
        back = lambda u: F.when(F.from_utc_timestamp(u, zone) == t, u)
        return once(at, lambda u: once(t - (F.from_utc_timestamp(u, zone) - u), back))

    def single(t: Column) -> Column:
        return once(F.to_utc_timestamp(t, zone), lambda near: once(F.struct(tried(t, near - day).alias("a"), tried(t, near + day).alias("b")), one))

    def one(u: Column) -> Column:
        return F.when(u["a"].isNull() | u["b"].isNull() | (u["a"] == u["b"]), F.coalesce(u["a"], u["b"]))

    return once(local, single)


#: The forms of due times that a reminder asked for at once may have, and what a text of each looks like. Each text
#: looks like one form at most, so that none is tried in vain: a text that Spark cannot read costs it an exception.
_DATE, _TIME = "^[+-]?[0-9]+-[+-]?[0-9]+-[+-]?[0-9]+", "[+-]?[0-9]+:[+-]?[0-9]+"
ASKED_FORMATS = (("y-M-d'T'H:m", f"{_DATE}[Tt]{_TIME}$"), ("y-M-d'T'H:m:s", f"{_DATE}[Tt]{_TIME}:[+-]?[0-9]+$"), ("y-M-d H:m", f"{_DATE} {_TIME}$"))


def asked_due(column: Column, zone: str) -> Column:
    """A local due time in UTC; null if no form reads it, or if the zone's clocks show it twice or never."""
    local = lambda t: F.coalesce(*[F.when(t.rlike(looks), F.try_to_timestamp(t, F.lit(form))) for form, looks in ASKED_FORMATS])
    return F.date_format(single_utc(once(column, local), zone), "yyyy-MM-dd HH:mm:ss")


def short(at: Column, now: Column) -> Column:
    """A due time as one reads it at a glance, by calendar days from now (both are seconds of the epoch, in UTC)."""
    t, minutes = F.timestamp_seconds(at), F.floor((at - now) / 60 + 0.5)
    days = F.datediff(F.to_date(t), F.to_date(F.timestamp_seconds(now)))
    clock, weekday, date = F.date_format(t, "h:mm a"), F.date_format(t, "EEEE"), F.date_format(t, "MMM d")
    past = F.when(days == 0, clock).when(days >= -6, F.concat(F.lit("Due "), weekday)).otherwise(F.concat(F.lit("Due "), date))
    soon = F.when(minutes < 60, F.concat(F.lit("In "), minutes.cast("string"), F.lit(" min"))).when(days == 0, F.concat(clock, F.lit(" today"))).when(days == 1, F.concat(F.lit("Tomorrow at "), clock))
    return F.when(minutes < 0, past).otherwise(F.coalesce(soon, F.when(days <= 6, F.concat(weekday, F.lit(" at "), clock)), date))


def tenant_or_nil(column: Column) -> Column:
    """A tenant's UUID in lower case; the nil one if it is missing or malformed."""
    ok = column.rlike(r"^[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}$")
    return F.when(ok, F.lower(column)).otherwise("00000000-0000-0000-0000-000000000000")
