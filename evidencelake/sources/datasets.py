"""Question sets and results as tables, with the rules a question set has to keep."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<accn:string,char_start:int,char_end:int,quote:string>"
QUESTION = f"id string, slice string, question string, value double, unit string, tag string, spans array<{SPAN}>, tickers array<string>, forms array<string>, period_end string, accn string, item_key string, origin string, gold_source string, note string"
SLICES = ("numeric", "narrative", "unanswerable")


def read_questions(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A question set, checked on every read; a broken one raises with all its faults."""
    q = spark.read.schema(QUESTION).json(path)
    if check:
        faults = violations(q).limit(20).collect()
        if faults:
            raise ValueError("; ".join(f"{r.id}: {r.rule}" for r in faults))
    return q


def violations(q: DataFrame) -> DataFrame:
    """(id, rule) for every rule a question breaks."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    n = F.coalesce(F.size("spans"), F.lit(0))
    of = lambda s: F.col("slice") == s
    rules = {
        "unknown slice": ~F.coalesce(F.col("slice").isin(*SLICES), F.lit(False)),
        "empty question": blank("question"),
        "no provenance": blank("origin") | blank("gold_source"),
        "numeric without a value": of("numeric") & F.col("value").isNull(),
        "numeric without a unit": of("numeric") & blank("unit"),
        "numeric without a span": of("numeric") & (n <= 0),
        "narrative without a span": of("narrative") & (n <= 0),
        "unanswerable with spans": of("unanswerable") & (n > 0),
        "unanswerable with a value": of("unanswerable") & F.col("value").isNotNull(),
        "empty span": F.coalesce(F.exists("spans", lambda s: s["char_end"] <= s["char_start"]), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    out = q.select("id", F.explode(broken).alias("rule"))
    twice = q.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("rule"))
    return out.unionByName(twice)


def freeze(q: DataFrame, path: str) -> str:
    """Write the set as one JSON Lines file in order of id, and return its SHA-256. A set is a few hundred hand-made rows."""
    rows = sorted((r.asDict(recursive=True) for r in q.collect()), key=lambda r: r["id"])
    raw = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows).encode()
    with open(path, "wb") as f:
        f.write(raw)
    return hashlib.sha256(raw).hexdigest()


def verify_spans(q: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, accn, char_start, problem) for gold spans that don't fit their document (accn, text)."""
    s = q.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    j = s.join(docs.select("accn", "text"), "accn", "left")
    got = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    problem = F.when(F.col("text").isNull(), "no such document").when((F.col("char_start") < 0) | (F.col("char_end") > F.length("text")), "out of range").when(got != F.col("quote"), "another quote")
    return j.withColumn("problem", problem).filter("problem is not null").select("id", "accn", "char_start", "problem")


def cached(outcomes: DataFrame, questions: DataFrame, fingerprint: str) -> DataFrame:
    """Questions without a good outcome under this fingerprint; failed ones are tried again."""
    good = outcomes.filter((F.col("fingerprint") == fingerprint) & (F.coalesce("error", F.lit("")) == "")).select("qid")
    return questions.join(good, questions["id"] == good["qid"], "left_anti")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
