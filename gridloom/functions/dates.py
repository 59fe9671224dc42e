"""Dates as text, and how long a position is locked. The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.values import Thresholds


def parse_date(text: Column) -> Column:
    """Timestamp of an ISO text, with or without time, fraction and offset; no offset means UTC. Other text gives null."""
    return F.try_to_timestamp(F.trim(text))


def resolution(a: Column, b: Column, as_of: Column, cap: float = Thresholds.date_cap_days) -> Column:
    """struct(resolution_date, days_to_resolution, date_capped): the later date, or the only one. Days stop at ``cap``, the date doesn't."""
    later = F.greatest(parse_date(a), parse_date(b))
    days = (F.unix_micros(later) - F.unix_micros(as_of)) / F.lit(86_400_000_000.0)
    return F.struct(
        later.alias("resolution_date"),
        F.when(days > cap, F.lit(float(cap))).otherwise(F.bround(days, 2)).alias("days_to_resolution"),
        F.coalesce(days > cap, F.lit(False)).alias("date_capped"),
    )


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")

