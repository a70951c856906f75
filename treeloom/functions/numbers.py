"""Number rules. Times travel as whole nanoseconds, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Halves go up: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def whole_millis(nanos: Column) -> Column:
    return F.floor(nanos / F.lit(1e6) + F.lit(0.5)).cast("bigint")


def seconds(nanos: Column) -> Column:
    """Nanoseconds to seconds with three decimals."""
    return whole_millis(nanos) / F.lit(1000.0)


def megabytes(byte_count: Column) -> Column:
    """Bytes to MB with two decimals; zero when missing."""
    return F.coalesce(rounded(byte_count / F.lit(1048576.0), 2), F.lit(0.0))


def iso_millis(ts: Column) -> Column:
    """ISO-8601 UTC text, cut to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
