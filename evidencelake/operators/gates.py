"""Assertions over whole stores, as tables of (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(name: str, counted: DataFrame, ok: Column, detail: Column) -> DataFrame:
    """One assertion over a table of one row."""
    return counted.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))


def none_of(name: str, offenders: DataFrame) -> DataFrame:
    return check(name, offenders.agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def at_least(name: str, rows: DataFrame, least: int) -> DataFrame:
    return check(name, rows.agg(F.count(F.lit(1)).alias("n")), F.col("n") >= least, F.concat(F.col("n").cast("string"), F.lit(f" of at least {least}")))


def every(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def corpus(companies: DataFrame, filings: DataFrame, payloads: DataFrame, listing: DataFrame, *, least: int, per_company: int) -> DataFrame:
    """Enough filings, all files there, a payload for every company, enough filings for each."""
    from evidencelake.sources import manifest

    few = companies.join(filings.groupBy("cik").agg(F.count(F.lit(1)).alias("n")), "cik", "left").filter(F.coalesce("n", F.lit(0)) < per_company)
    return every(
        at_least("corpus size", filings, least), none_of("manifest matches disk", manifest.missing_files(filings, listing)),
        none_of("payload for every company", companies.join(payloads.select("cik"), "cik", "left_anti")), none_of("filings for every company", few),
    )


def numbers(facts: DataFrame, years: DataFrame, judged: DataFrame, least: int) -> DataFrame:
    """Facts there, no repeated identity, spans known, years for every company, and expected values met."""
    from evidencelake.operators import facts as f

    return every(
        at_least("facts loaded", facts, least), none_of("identities are unique", f.duplicate_keys(facts, *f.IDENTITY, "accn")),
        none_of("instants have no length", facts.filter("period_start is null and span <> 'instant'")),
        none_of("years for every company", facts.select("cik").distinct().join(years.select("cik"), "cik", "left_anti")), none_of("expected values", judged.filter("not ok")),
    )


def texts(outcomes: DataFrame, chunks: DataFrame, audit: DataFrame, least_split: float, *, indexed: DataFrame, edge_audit: DataFrame) -> DataFrame:
    """Every document accounted for, few unsplit, ids unique, slices true, every chunk indexed and edges' sentences true.

    indexed: chunk_id of the index's rows; audit and edge_audit: what ``chunking.audit`` found.
    """
    lost = chunks.select("chunk_id").join(indexed.select("chunk_id"), "chunk_id", "left_anti").unionByName(indexed.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
    share = outcomes.agg(F.avg((F.col("status") == "split").cast("double")).alias("s"))
    return every(
        check("documents split", share, F.col("s") >= least_split, F.round("s", 4)), none_of("documents without a reason", outcomes.filter("status <> 'split' and reason is null")),
        none_of("chunk ids are unique", chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), none_of("chunks are slices", audit),
        none_of("the index has the chunks", lost), none_of("edges quote their sentence", edge_audit),
    )


def judge(got: DataFrame, expected: DataFrame, key: str = "question") -> DataFrame:
    """(question, expected, got, ok): a value within half a percent or 0.05, whichever is more."""
    j = expected.join(got, key, "left")
    near = F.abs(F.col("got") - F.col("expected")) <= F.greatest(F.abs("expected") * 0.005, F.lit(0.05))
    return j.select(key, "expected", "got", F.coalesce(near, F.lit(False)).alias("ok"))


def gallery(failures: DataFrame) -> DataFrame:
    """Tags of failures (qid, tags) add up: at least as many tags as tagged failures, and some."""
    one = failures.agg(F.sum(F.size("tags")).alias("tags"), F.sum((F.size("tags") > 0).cast("long")).alias("tagged"))
    return check("failure tags add up", one, (F.col("tags") >= F.col("tagged")) & (F.col("tagged") > 0), F.concat_ws("/", F.col("tags").cast("string"), F.col("tagged").cast("string")))
