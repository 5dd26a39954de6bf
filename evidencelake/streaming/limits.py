"""Rate limits and event windows, over tables and over streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str = "ts"):
    """A timestamp as microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_audit(events: DataFrame, key: str, limit: int, window_s: float = 60.0, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Marks that are more than ``limit`` within a window. A mark has left when it is ``window_s`` old."""
    span = int(window_s * 1e6)
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-span + 1, 0)
    return events.withColumn("_us", micros(ts)).withColumn("in_window", F.count(F.lit(1)).over(w)).filter(F.col("in_window") > limit).select(key, tie, ts, "in_window")


def budget_audit(events: DataFrame, key: str, size: str, budget: float, window_s: float = 60.0, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batches that take the window's total over ``budget``; one alone in its window may be larger."""
    span = int(window_s * 1e6)
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-span + 1, 0)
    e = events.withColumn("_us", micros(ts)).withColumn("total", F.sum(size).over(w)).withColumn("in_window", F.count(F.lit(1)).over(w))
    return e.filter((F.col("total") > budget) & (F.col("in_window") > 1)).select(key, tie, ts, "total", "in_window")


def limiter(events: DataFrame, key: str, limit: int, window_s: float = 60.0, ts: str = "ts") -> DataFrame:
    """A stream's marks with the wait that keeps each window within ``limit``: (key, ts, wait_s).

    The state of a key is the last ``limit`` admissions, so it is bounded.
    """
    out = f"{key} string, ts timestamp, wait_s double"

    def admit(k, batches, state):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))[[ts]].sort_values(ts)
        got = []
        for t in rows[ts]:
            now = t.value / 1e9
            start = max(now, held[-1] if held else now)
            if len(held) >= limit:
                start = max(start, held[-limit] + window_s)
            held = [*held, start][-limit:]
            got.append((str(k[0]), t, start - now))
        state.update((held,))
        yield pd.DataFrame(got, columns=[key, "ts", "wait_s"])

    return events.groupBy(key).applyInPandasWithState(admit, out, "held array<double>", "append", "NoTimeout")


def tumbling(events: DataFrame, width: str, *by: str, ts: str = "ts", value: str = "value") -> DataFrame:
    g = events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, key: str, gap_s: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Sessions of a key: a new one where more than ``gap_s`` passed since the event before."""
    w = Window.partitionBy(key).orderBy("_us", tie)
    e = events.withColumn("_us", micros(ts))
    new = F.coalesce((F.col("_us") - F.lag("_us").over(w) > gap_s * 1_000_000).cast("int"), F.lit(1))
    s = e.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def streamed_windows(events: DataFrame, width: str, lateness: str, *by: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Windowed counts and sums of a stream, closed ``lateness`` after their end."""
    return tumbling(events.withWatermark(ts, lateness), width, *by, ts=ts, value=value)


def once(events: DataFrame, key: str, lateness: str, ts: str = "ts") -> DataFrame:
    """A stream without events of a key seen within ``lateness``."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
