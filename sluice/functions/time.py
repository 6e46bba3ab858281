"""Timestamps as whole microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, ts: str) -> Column:
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts))
    return F.unix_micros(F.col(ts))
