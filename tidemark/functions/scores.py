"""Numbers: similarity, score conversions, priorities, durations, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def clamped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def search_score(cos: Column) -> Column:
    """Of a search hit: 1 - distance / 2, with the cosine distance."""
    return clamped((1 + cos) / 2)


def chain_similarity(cos: Column) -> Column:
    """Of a version to the head of its chain: the cosine itself."""
    return clamped(cos)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 745, 1.0).when(x <= -745, 0.0).otherwise(1 / (1 + F.exp(-x)))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("weak")


def as_percent(x: Column) -> Column:
    """An efficiency given as a share or as a percentage."""
    return F.when(x <= 1, x * 100).otherwise(x)


def task_priority(priority: Column) -> Column:
    """0-9 as reminder apps keep it (0 none, 1-3 highest, 4 high, 5-7 medium, 8-9 low) to null and 1-4."""
    return F.when(priority.between(1, 3), 1).when(priority == 4, 2).when(priority.between(5, 7), 3).when(priority.between(8, 9), 4)


def duration_minutes(start: Column, end: Column) -> Column:
    minutes = F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("int")
    return F.when(minutes > 0, minutes)


def duration_label(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
    )


def due_class(due: Column, today: Column) -> Column:
    return F.when(due.isNull(), "none").when(due < today, "overdue").when(due == today, "today").when(due <= F.next_day(F.date_sub(today, 1), "SAT"), "this-week").otherwise("future")


def iso_week_key(day: Column, iso_year: bool = False) -> Column:
    """'2025-W01'. The year is the calendar year, unless iso_year asks for the week's own."""
    year = F.extract(F.lit("YEAROFWEEK"), day) if iso_year else F.year(day)
    return F.format_string("%04d-W%02d", year.cast("int"), F.weekofyear(day))


def day_header(day: Column) -> Column:
    """'Saturday, March 21, 2026'."""
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def week_header(day: Column) -> Column:
    """'Week 12: Mar 16 – Mar 22, 2026', with the year of its Sunday."""
    monday = F.date_trunc("week", day).cast("date")
    sunday = F.date_add(monday, 6)
    return F.format_string("Week %d: %s – %s, %s", F.weekofyear(day), F.date_format(monday, "MMM d"), F.date_format(sunday, "MMM d"), F.date_format(sunday, "yyyy"))


def clock(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.floor(seconds).cast("int")
    hours, minutes, rest = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
