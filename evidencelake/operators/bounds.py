"""Broadcasts whose size is checked, and another way beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, most: int = ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blocks(df: DataFrame, key: str, most: int = ROWS) -> list[DataFrame]:
    """A stated query set in parts of about ``most`` rows, each to be broadcast against all rows."""
    n = max(1, -(-df.count() // most))
    return [F.broadcast(df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
