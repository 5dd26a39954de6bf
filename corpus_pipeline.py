"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

1. quality: documents whose vote is under 0.3 go.
2. near_dedup: of each group of near-duplicates the document of the smallest id stays.
3. substring_dedup: passages of 20 words and more that an earlier document holds go from the text.
4. decontaminate: documents that hold ten consecutive words of a benchmark item go.
5. pack: what is left is packed into sequences of 2048 tokens.

All stages but the last return the columns of ``documents``, extra ones with
whatever names too.

Defined results, stage by stage:

1. A text without words (null, empty) gets the labelled share of good texts as
   its score, so it stays where that is 0.3 or more; without labels all rows stay.
2. Rows without an id or without words stay; rows of one id stay or go together;
   of equal texts the smallest id stays.
3. Null, empty and short texts stay as they are; what is cut from others leaves
   their words joined by one space, and ``n_chars`` is that text's length.
4. Rows without words stay; an empty benchmark removes nothing.
5. Each row is packed, null and empty texts as the end id alone; a null id stays.

Repeated rows are judged alike by 1 and 4; texts of any length are read whole; an
empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm import decontaminate, neardup, packing, quality, substring
from evidencelake.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.clean(docs, chars_col="n_chars")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: The quality vote and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
