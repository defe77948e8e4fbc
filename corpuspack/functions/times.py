"""Times as numbers, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 00:00. A ``timestamp_ntz`` (wall clock) is read as
    UTC wall clock, whatever the session time zone; a ``timestamp`` is an instant."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))
