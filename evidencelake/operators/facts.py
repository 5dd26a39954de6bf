"""Views over reported facts: the current value of each period, restatements, identity checks.

A fact: cik, ticker, taxonomy, tag, unit, period_start (null for an instant),
period_end, span, val, accn, filed and what else the source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["cik", "taxonomy", "tag", "unit", "period_start", "period_end"]


def current(facts: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The latest report of every period. Null starts are one value, so instants are deduplicated too."""
    order = [F.col(c).desc_nulls_last() for c in ("filed", "accn", *tie_break)]
    w = Window.partitionBy(*IDENTITY).orderBy(*order)
    return facts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def restatements(facts: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Periods reported with more than one value, with the first and the last of them."""
    key = F.struct("filed", "accn", *tie_break)
    g = facts.groupBy("cik", "ticker", "taxonomy", "tag", "unit", "period_start", "period_end", "span").agg(
        F.count_distinct("val").alias("n_values"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"),
        F.min_by("val", key).alias("first_val"), F.max_by("val", key).alias("last_val"),
    )
    return g.filter("n_values > 1").withColumn("delta", F.col("last_val") - F.col("first_val"))


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys held by more than one row (nulls equal), with how many."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def histogram(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def balance_violations(facts: DataFrame, assets: str, parts: list[str], optional_prefix: str = "", tolerance: float = 0.005) -> DataFrame:
    """Balance sheets (ticker, accn, period_end) whose parts miss the total by more than ``tolerance`` of it.

    Parts that are missing count as zero; all of ``parts`` but the last must be
    there for a sheet to be judged.
    """
    of = lambda t: F.max(F.when(F.col("tag") == t, F.col("val")))
    cols = [of(assets).alias("total"), *[of(p).alias(f"p{i}") for i, p in enumerate(parts)]]
    if optional_prefix:
        cols.append(F.max(F.when(F.col("tag").startswith(optional_prefix), F.col("val"))).alias("extra"))
    g = facts.groupBy("ticker", "accn", "period_end").agg(*cols)
    have = F.col("total").isNotNull()
    for i in range(max(1, len(parts) - 1)):
        have = have & F.col(f"p{i}").isNotNull()
    rest = F.col("total")
    for i in range(len(parts)):
        rest = rest - F.coalesce(F.col(f"p{i}"), F.lit(0.0))
    if optional_prefix:
        rest = rest - F.coalesce("extra", F.lit(0.0))
    return g.filter(have).withColumn("gap", rest).filter(F.abs("gap") > tolerance * F.abs("total")).select("ticker", "accn", "period_end", "total", "gap")
