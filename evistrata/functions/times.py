"""Column functions on times: schedule slots, retries, retention, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(at: Column, seconds: int) -> Column:
    """Start of the schedule slot: the epoch second rounded down to the interval."""
    s = F.unix_seconds(at.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds))).cast("timestamp_ntz")


def retry_delay(attempt: Column, base: int = 30, most: int = 900) -> Column:
    """Seconds until the next attempt: doubled each time, up to a bound."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def month_start(at: Column) -> Column:
    return F.date_trunc("month", at).cast("timestamp_ntz")


def retained_until(collected: Column, category: Column, days: dict[str, int]) -> Column:
    """End of retention by category; null for a category without a rule, which must not be kept."""
    rule = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])[category]
    return collected + F.make_dt_interval(rule)


def freshness_state(age_seconds: Column, most: int) -> Column:
    return F.when(age_seconds <= most / 2, "fresh").when(age_seconds <= most, "aging").otherwise("stale")


def block_reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order: empty means allowed."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def midnight(day: Column) -> Column:
    """The start of a day; null for null."""
    return day.cast("date").cast("timestamp_ntz")
