"""Connected components of an edge table by alternating large and small stars, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import discard, materialise

#: A key is hot if it has more than this share of the rows, so at most ``HOT`` keys are; tables of at most ``PLAIN`` rows need no care.
HOT, PLAIN = 256, 1_000_000


def join_keyed(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``n`` how many of the ``rows`` rows of ``left`` have it.

    Rows of hot keys stay where they are: their few keys are broadcast. The
    others are shuffled. Both read ``left``, so give a written table.
    """
    if rows <= PLAIN:
        return left.join(right.drop("n"), key)
    hot, cold = right.filter(F.col("n") * HOT > rows).drop("n"), right.filter(F.col("n") * HOT <= rows).drop("n")
    few = F.broadcast(hot)
    return left.join(few, key).unionByName(left.join(few, key, "left_anti").join(cold, key))


def _stars(e: DataFrame, rows: int, large: bool) -> DataFrame:
    """One star step over (hi, lo), hi > lo."""
    if large:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = join_keyed(both.filter("v > u"), least, "u", 2 * rows).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        out = join_keyed(e, least, "hi", rows).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
    return out.filter("hi > lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge; a node without links isn't listed.

    Stars are made of minima, so a node with many links is a partial
    aggregation, and its rows are not dealt to one task; rounds grow as the
    logarithm of the longest path. Each round is written to the shared folder,
    which ends its lineage.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct(), "edges")
    rows, before = e.count(), None
    while True:
        step = _stars(e, rows, True)
        if rows > PLAIN:
            step = materialise(step, "large")
        step = materialise(_stars(step, rows, False), "stars")
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        discard(e)
        e, rows = step, now[0]
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
