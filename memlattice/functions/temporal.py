"""Validity and age; times are ISO strings that compare as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(valid_from: Column, valid_to: Column, at: str | Column) -> Column:
    """Inclusive at both ends; an open end is null."""
    at = F.lit(at) if isinstance(at, str) else at
    return F.coalesce(valid_from <= at, F.lit(True)) & F.coalesce(valid_to >= at, F.lit(True))


def days_ago(stamp: Column, now: str) -> Column:
    """Whole days, at least 0; 30 for a string too short for a date, null for one that is none."""
    day = F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.length(stamp) < 10, F.lit(30)).otherwise(F.greatest(F.datediff(F.lit(now[:10]).cast("date"), day), F.lit(0))).cast("double")


def closing_time(old_to: Column, new_from: Column, now: str) -> Column:
    """valid_to of a row that another supersedes: its own if that is earlier than the boundary."""
    boundary = F.coalesce(F.nullif(new_from, F.lit("")), F.lit(now))
    own = F.nullif(old_to, F.lit(""))
    return F.when(own < boundary, own).otherwise(boundary)


def normalise_stamp(c: Column) -> Column:
    """Sentinel times become null, a space between date and time a T."""
    return F.when((c.isNull()) | (c == "") | (c <= "1970-01-02"), F.lit(None).cast("string")).otherwise(F.replace(c, F.lit(" "), F.lit("T")))
