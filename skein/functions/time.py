"""Date and time expressions. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(x: Column) -> Column:
    """ISO 8601 text to a timestamp; null if it is none."""
    return F.try_to_timestamp(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), x))


def format_time(x: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(x, pattern)


# fixed values: the labels of relative times
AGO = {"zh": ("刚刚", "分钟前", "小时前", "天前", "个月前", "年前"), "en": ("just now", " minutes ago", " hours ago", " days ago", " months ago", " years ago")}


def time_ago(x: Column, now: Column, language: str = "zh") -> Column:
    """A relative label: just now, minutes, hours, days, months of 30 days, years of 365."""
    s, labels = F.unix_timestamp(now) - F.unix_timestamp(x), AGO[language]
    steps = [(60, 3600), (3600, 86400), (86400, 2592000), (2592000, 31536000), (31536000, None)]
    out = F.when(s < 60, labels[0])
    for (unit, end), label in zip(steps, labels[1:]):
        text = F.concat(F.floor(s / unit).cast("string"), F.lit(label))
        out = out.when(s < end, text) if end else out.otherwise(text)
    return out


def time_decay(x: Column, now: Column, rate: float = 0.1) -> Column:
    """exp(-rate * whole days)."""
    return F.exp(-F.lit(rate) * F.floor((F.unix_timestamp(now) - F.unix_timestamp(x)) / 86400))


def to_shanghai(x: Column) -> Column:
    return F.from_utc_timestamp(x, "Asia/Shanghai")


def to_naive_utc(x: Column, zone: str) -> Column:
    return F.to_utc_timestamp(x, zone)


def overlaps(start: Column, end: Column, query_start=None, query_end=None) -> Column:
    """Interval overlap; a row without end counts by its start alone; either bound of the query may be open."""
    lo = F.lit(query_start).cast("timestamp") if query_start is not None else None
    hi = F.lit(query_end).cast("timestamp") if query_end is not None else None
    spans, point = end.isNotNull(), end.isNull()
    if hi is not None:
        spans, point = spans & (start <= hi), point & (start <= hi)
    if lo is not None:
        spans, point = spans & (end >= lo), point & (start >= lo)
    return spans | point
