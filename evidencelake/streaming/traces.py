"""Spans of traces as a tree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth(spans: DataFrame, start: str = "start_ns") -> DataFrame:
    """span_id, depth, path and nth (its place among its siblings by ``start``, 0 for roots) of every span that hangs on a root; a span whose parent isn't there is a root itself.

    Each round doubles how far up a span has looked, so rounds grow as the
    logarithm of the depth, which has no limit. A round is a join over the spans
    that have not met their root yet; what it leaves is written to the shared
    folder, which ends its lineage. Spans on a
    circle of parents hang on no root and fall away.
    """
    s = spans.select("span_id", "parent_id", F.col(start).alias("start"))
    known = s.select(F.col("span_id").alias("_known")).distinct()
    s = s.join(known, s["parent_id"] == F.col("_known"), "left").select("span_id", F.when(F.col("_known").isNotNull(), F.col("parent_id")).alias("up"), "start")
    among = Window.partitionBy(F.col("up").isNull(), F.coalesce("up", "span_id")).orderBy("start", "span_id")
    s = s.withColumn("nth", F.when(F.col("up").isNull(), 0).otherwise(F.row_number().over(among)))
    own = F.col("span_id").cast("string")
    at = _written(s.select("span_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), own.alias("path"), "nth"))
    left = at.filter("up is not null").count()
    while left:
        above = at.select(F.col("span_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        j = at.join(above, at["up"] == above["_id"], "left")
        # what stands above ends where this one begins: its path goes in front, its way up goes on
        at = _written(j.select("span_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.concat_ws("/", "_path", "path").alias("path"), "nth"))
        now = at.filter("up is not null").count()
        if now == left:  # circles alone are left, they never end
            break
        left = now
    return at.filter("up is null").select("span_id", "depth", "path", "nth")


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/spans-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def waterfall(spans: DataFrame) -> DataFrame:
    """Spans with their offset from the start of the trace, in milliseconds."""
    first = F.min("start_ns").over(Window.partitionBy("trace_id"))
    return spans.withColumn("offset_ms", (F.col("start_ns") - first) / F.lit(1e6))


def counters(spans: DataFrame) -> DataFrame:
    return spans.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.sum((F.col("status") != "ok").cast("long")).alias("failed"))


def search(spans: DataFrame, **where) -> DataFrame:
    """Spans whose columns or attributes have the values given."""
    out = F.lit(True)
    for k, v in where.items():
        got = F.col(k) if k in spans.columns else F.element_at("attributes", k)
        out = out & got.eqNullSafe(F.lit(v))
    return spans.filter(out)
