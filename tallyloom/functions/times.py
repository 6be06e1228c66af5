"""Clock text, durations and their spellings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, with its fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds; negative where they are the wrong way round."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def elapsed(start: Column, updated: Column, terminal: Column, as_of: Column) -> Column:
    """Seconds from start to the last update of what has ended, to `as_of` otherwise; never negative, null without start."""
    end = F.when(terminal & updated.isNotNull(), updated).otherwise(as_of)
    return F.when(start.isNotNull(), F.greatest(F.lit(0.0), seconds_between(start, end)))


def parse_clock(text: Column) -> Column:
    """Seconds of a text that begins with HH:MM:SS, else null."""
    pattern = r"^(\d{2}):(\d{2}):(\d{2})"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("bigint")
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def parse_clock_loose(text: Column) -> Column:
    """Seconds of the first [HH:MM:SS] or [MM:SS] of a text, else 0."""
    long, short = r"\[(\d{1,2}):(\d{2}):(\d{2})\]", r"\[(\d{1,2}):(\d{2})\]"
    at = lambda p, i: F.regexp_extract(text, p, i).cast("bigint")
    return F.when(text.rlike(long), at(long, 1) * 3600 + at(long, 2) * 60 + at(long, 3)).when(text.rlike(short), at(short, 1) * 60 + at(short, 2)).otherwise(0)


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS of the whole seconds."""
    s = F.floor(seconds).cast("bigint")
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def format_minutes(seconds: Column) -> Column:
    """M:SS of the whole seconds."""
    s = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), _two(s % 60))


def remaining_text(seconds: Column) -> Column:
    """45s, 7m, 2h 5m: seconds are rounded, not below 0, minutes are whole ones; whole hours without minutes."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    h = F.floor(m / 60)
    hours = F.concat(h.cast("string"), F.lit("h"), F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit("m"))).otherwise(""))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(hours)


def range_text(low: Column, high: Column) -> Column:
    """`eta 5m–7m`, the smaller first; `eta ~5m` with only a low, `eta up to 7m` with only a high bound; null without both."""
    both = F.concat(F.lit("eta "), remaining_text(F.least(low, high)), F.lit("–"), remaining_text(F.greatest(low, high)))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(F.lit("eta ~"), remaining_text(low))).when(high.isNotNull(), F.concat(F.lit("eta up to "), remaining_text(high)))


def shown_progress(percent: Column) -> Column:
    """0 for null, kept within 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(percent, F.lit(0))))


def elapsed_text(seconds: Column) -> Column:
    """2h 5m, 5m 3s, 3s: rounded, not below 0; a dash for null."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    return F.when(seconds.isNull(), F.lit("—")).when(h > 0, text(h, "h ", m, "m")).when(m > 0, text(m, "m ", s % 60, "s")).otherwise(text(s, "s"))


def compact_date(text: Column) -> Column:
    """yyyy-MM-dd of a text yyyyMMdd, null if it is no date."""
    return F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{8}$"), text), F.lit("yyyyMMdd"))).cast("string")
