"""Retry delays as column expressions. Jitter is an argument (0 to 1), so plans stay deterministic without it."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a header of seconds or of a mail-style date; never negative, null if unreadable."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | (GMT|UTC)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def full_jitter(attempt: Column, base: float, cap: float, jitter: Column | None = None) -> Column:
    top = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))
    return top if jitter is None else top * jitter


def delivery_delay(attempt: Column, base: float, cap: float, jitter: Column | None = None) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt) * (F.lit(1.0) if jitter is None else jitter + 0.5))


def task_delay(retries: Column) -> Column:
    return F.least(30 * F.pow(F.lit(2.0), retries), F.lit(180.0))


def recovery_delay(attempts: Column, jitter: Column | None = None) -> Column:
    top = F.least(30 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(1800.0))
    return top if jitter is None else top * (0.8 + 0.4 * jitter)


def cooldown_remaining(at: Column, pause: Column, by: list[str], order: list[Column]) -> Column:
    """Seconds each call has yet to wait for what earlier calls by the same client were told to pause.

    ``at`` is in seconds; a null or negative ``pause`` is none. A later, shorter pause never ends an earlier one.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(at + F.greatest(F.coalesce(pause, F.lit(0)), F.lit(0))).over(before)
    return F.greatest(F.coalesce(until - at, F.lit(0)), F.lit(0))
