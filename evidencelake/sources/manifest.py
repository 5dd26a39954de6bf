"""The manifest of what was fetched: companies, filings and fact payloads, kept by upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str, update: list[str] | None = None) -> DataFrame:
    """``table`` after inserting ``rows`` or, where the key is there, updating ``update`` (all columns by default); others keep their first value."""
    cols = table.columns
    changed = [c for c in cols if c != key] if update is None else update
    new = rows.select(*[F.col(c).alias(f"_n_{c}") for c in cols])
    j = table.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), F.col(key) == F.col(f"_n_{key}"), "full_outer")
    pick = lambda c: (
        F.coalesce(key, f"_n_{key}") if c == key else F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in changed)), F.col(f"_n_{c}")).otherwise(F.col(c))
    )
    return j.select(*[pick(c).alias(c) for c in cols])


def prune(table: DataFrame, keep: DataFrame, key: str = "cik") -> DataFrame:
    """Rows whose key is kept; an empty ``keep`` removes nothing. Null keys stay, as with NOT IN."""
    k = keep.select(F.col(key).alias("_k")).distinct()
    gone = table.filter(F.col(key).isNotNull()).join(k, F.col(key) == F.col("_k"), "left_anti").select(F.col(key).alias("_g")).distinct()
    some = k.agg((F.count(F.lit(1)) > 0).alias("_some"))
    gone = gone.crossJoin(F.broadcast(some)).filter("_some").drop("_some")  # one row
    return table.join(gone, F.col(key) == F.col("_g"), "left_anti")


def fresh(wanted: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    """What is wanted and not there yet."""
    return wanted.join(have.select(*keys), list(keys), "left_anti")


def missing_files(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose path isn't among the files (path)."""
    return rows.join(listing.select("path"), "path", "left_anti")


def stats(companies: DataFrame, filings: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda df, **c: df.agg(*[x.alias(k) for k, x in c.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = n(companies, companies=F.count(F.lit(1)))
    b = n(filings, filings=F.count(F.lit(1)), companies_with_filings=F.count_distinct("cik"), filing_bytes=total("bytes"))
    c = n(payloads, companyfacts=F.count(F.lit(1)), facts_bytes=total("bytes"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def per_company(companies: DataFrame, filings: DataFrame, payloads: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """Counts and bytes for every company; each side is aggregated before the join, so nothing fans out."""
    f = filings.groupBy("cik").agg(
        *[F.sum((F.col("form") == x).cast("long")).alias(f"n_{x.lower().replace('-', '')}") for x in forms],
        F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"), F.sum("bytes").alias("filing_bytes"),
    )
    p = payloads.groupBy("cik").agg(F.sum("n_concepts").alias("n_concepts"))
    j = companies.select("cik", "ticker").join(f, "cik", "left").join(p, "cik", "left")
    return j.na.fill(0, [f"n_{x.lower().replace('-', '')}" for x in forms] + ["filing_bytes", "n_concepts"])


def largest(filings: DataFrame, n: int) -> DataFrame:
    return filings.orderBy(F.col("bytes").desc(), "accn").limit(n)
