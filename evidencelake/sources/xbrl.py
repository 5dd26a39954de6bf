"""Nested fact payloads as rows: taxonomy, tag and unit are data, so they are map keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import spans

ENTRY = "struct<start:string,end:string,val:string,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
TAG = f"struct<label:string,description:string,units:map<string,array<{ENTRY}>>>"
PAYLOAD = f"struct<facts:map<string,map<string,{TAG}>>>"


def _exploded(payloads: DataFrame, json_col: str) -> DataFrame:
    """A row for each entry. A value keeps its raw JSON text next to it, so that text isn't taken for a number."""
    p = payloads.select("cik", "ticker", F.from_json(json_col, PAYLOAD).alias("p"))
    t = p.select("cik", "ticker", F.explode("p.facts").alias("taxonomy", "tags")).select("cik", "ticker", "taxonomy", F.explode("tags").alias("tag", "body"))
    u = t.select("cik", "ticker", "taxonomy", "tag", F.explode("body.units").alias("unit", "entries"))
    return u.select("cik", "ticker", "taxonomy", "tag", "unit", F.explode("entries").alias("e"))


def flatten(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Facts and skips (cik, ticker, payload): column ``skip`` is null for a fact, else ``date`` or ``value``.

    An entry without a good end or filing date or accession number is skipped for
    its date, one whose value is missing or no number for its value.
    """
    e = _exploded(payloads, json_col)
    start, end, filed = (F.try_to_date(F.col(f"e.{c}"), "yyyy-MM-dd") for c in ("start", "end", "filed"))
    val = F.col("e.val").try_cast("double")
    skip = F.when(end.isNull() | filed.isNull() | F.col("e.accn").isNull(), "date").when(val.isNull(), "value")
    days = spans.period_days(start, end)
    return e.select(
        "cik", "ticker", "taxonomy", "tag", "unit", start.alias("period_start"), end.alias("period_end"), spans.period_type(start).alias("period_type"), days.alias("period_days"),
        spans.classify(days).alias("span"), val.alias("val"), F.col("e.accn").alias("accn"), F.col("e.form").alias("form"), filed.alias("filed"), F.col("e.frame").alias("frame"),
        F.col("e.fy").alias("filed_fy"), F.col("e.fp").alias("filed_fp"), skip.alias("skip"),
    )


def facts(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    return flatten(payloads, json_col).filter("skip is null").drop("skip")


def skipped(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    return flatten(payloads, json_col).filter("skip is not null").groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


def concepts(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """(taxonomy, tag) -> label, description as the first company by ticker gives them."""
    p = payloads.select("ticker", F.from_json(json_col, PAYLOAD).alias("p"))
    t = p.select("ticker", F.explode("p.facts").alias("taxonomy", "tags")).select("ticker", "taxonomy", F.explode("tags").alias("tag", "body"))
    return t.groupBy("taxonomy", "tag").agg(F.min_by(F.struct("body.label", "body.description"), "ticker").alias("b")).select("taxonomy", "tag", "b.label", "b.description")


def concept_count(payload):
    """Tags in a payload, over all taxonomies."""
    return F.aggregate(F.transform(F.map_values(F.from_json(payload, PAYLOAD)["facts"]), lambda m: F.size(m)), F.lit(0), lambda a, b: a + b)
