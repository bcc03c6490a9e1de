"""Time helpers that do not depend on the session time zone.

Event time travels as epoch microseconds (BIGINT) or TIMESTAMP.  Hour and
weekday are computed arithmetically from epoch microseconds so results are
identical whatever ``spark.sql.session.timeZone`` a cluster uses; a local
zone is applied with ``from_utc_timestamp`` (a pure instant shift).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

US_PER_SEC = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SEC
US_PER_DAY = 24 * US_PER_HOUR

# Fixed values (time-of-day bands and their expected density factor).
# morning [6,12) 0.6 · afternoon [12,17) 0.8 · evening [17,21) 0.9 · night [21,6) 0.4
TOD_DENSITY = {"morning": 0.6, "afternoon": 0.8, "evening": 0.9, "night": 0.4}


def micros_of(df: DataFrame, col: str) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(col))
    return F.col(col).cast("bigint")


def ts_of(us) -> Column:
    """TIMESTAMP from epoch microseconds."""
    c = us if isinstance(us, Column) else F.col(us)
    return F.timestamp_micros(c)


def local_us(us, tz: str | None = None) -> Column:
    """Wall-clock microseconds in ``tz`` (UTC when None)."""
    c = us if isinstance(us, Column) else F.col(us)
    if tz is None or tz.upper() == "UTC":
        return c
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), tz))


def hour_of_us(us) -> Column:
    c = us if isinstance(us, Column) else F.col(us)
    return F.pmod(F.floor(c / F.lit(US_PER_HOUR)), F.lit(24)).cast("bigint")


def dow0_of_us(us) -> Column:
    """Day of week, 0 = Sunday (1970-01-01 was a Thursday)."""
    c = us if isinstance(us, Column) else F.col(us)
    return F.pmod(F.floor(c / F.lit(US_PER_DAY)) + F.lit(4), F.lit(7)).cast("bigint")


def time_of_day(hour) -> Column:
    """morning [6,12) · afternoon [12,17) · evening [17,21) · night otherwise."""
    h = hour if isinstance(hour, Column) else F.col(hour)
    return (
        F.when((h >= 6) & (h < 12), F.lit("morning"))
        .when((h >= 12) & (h < 17), F.lit("afternoon"))
        .when((h >= 17) & (h < 21), F.lit("evening"))
        .otherwise(F.lit("night"))
    )
