"""Time columns as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a TIMESTAMP, TIMESTAMP_NTZ or integer column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_millis(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(F.col(name))
    return F.col(name).cast("bigint")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def floor_to(ms: Column, width_ms: int) -> Column:
    """Start of the epoch-aligned cell of ``width_ms`` that holds ``ms``."""
    return ms - F.pmod(ms, F.lit(int(width_ms)).cast("bigint"))
