"""Session settings that every plan here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable between engines; AQE re-plans joins and
#: splits skewed partitions from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "evidencelake", **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; ``extra`` wins. ``master`` None leaves it to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()
