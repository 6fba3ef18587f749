"""Rounding as Python's round() does it: the double's exact value, ties to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^27 + 1, which splits a double into halves whose products are exact.
SPLITTER = 134217729.0


def python_round(x: Column, digits: int = 6) -> Column:
    """x to that many digits (10 at most, |x| below 1e5 or so): what the product with the power of ten loses decides what looks like a tie."""
    scale = float(10**digits)
    t = x * scale
    whole = F.floor(t).cast("double")
    high = x * SPLITTER - (x * SPLITTER - x)
    lost = (high * scale - t) + (x - high) * scale
    up = (t - whole > 0.5) | ((t - whole == 0.5) & ((lost > 0) | ((lost == 0) & (F.pmod(whole, F.lit(2.0)) == 1.0))))
    return F.when(x.isNull(), F.lit(None)).otherwise((whole + F.when(up, 1.0).otherwise(0.0)) / scale)


def python_round_sql(x: str, digits: int = 6) -> str:
    """The same in DuckDB's SQL."""
    s, c = f"1e{digits}", f"{SPLITTER}::DOUBLE"
    lost = f"(({c} * v - ({c} * v - v)) * {s} - v * {s}) + (v - ({c} * v - ({c} * v - v))) * {s}"
    up = f"v * {s} - floor(v * {s}) > 0.5 OR (v * {s} - floor(v * {s}) = 0.5 AND (({lost}) > 0 OR (({lost}) = 0 AND floor(v * {s})::BIGINT % 2 <> 0)))"
    return f"(list_transform([({x})::DOUBLE], lambda v: (floor(v * {s}) + CASE WHEN {up} THEN 1 ELSE 0 END) / {s})[1])"
