"""Staging, copies, vector stores and results on shared storage."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"nullValue": "\\N", "escape": "\""}


def stage_csv(df: DataFrame, path: str) -> None:
    """CSV in which null and the empty string stay apart."""
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def copy(spark: SparkSession, source: str, target: str) -> int:
    """A table rewritten whole at another place; the number of rows."""
    df = spark.read.parquet(source)
    df.write.mode("overwrite").parquet(target)
    return df.count()


def store_name(backend: str, model: str, dim: int, variant: str = "", prefix: str = "vectors") -> str:
    """Backend, model and width are part of a vector store's name, so that unlike vectors never meet."""
    slug = re.sub(r"[/:]", "_", model).replace(".", "-")
    return "__".join([prefix, backend, slug, str(dim), *([variant] if variant else [])])


def open_store(spark: SparkSession, folder: str, name: str, dim: int, vec_col: str = "vector") -> DataFrame:
    """A vector store by name; one that isn't there, is empty or holds another width is an error."""
    path = f"{folder}/{name}"
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        raise LookupError(f"no vector store at {path}") from e
    widths = {r[0] for r in df.select(F.size(vec_col)).distinct().limit(2).collect()}
    if widths != {dim}:
        raise LookupError(f"{path} holds vectors of {sorted(widths)} dimensions, not {dim}")
    return df


def embed_missing(chunks: DataFrame, have: DataFrame, encoder: Callable[[pd.Series], pd.Series], *, id_col="chunk_id", text_col="text", batch: int = 32) -> DataFrame:
    """Vectors (unit length) of the chunks that have none yet; ``encoder`` gives a list of floats for each text."""

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(text), batch):
            v = np.asarray(list(encoder(text.iloc[i : i + batch])), float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            out.extend(v / np.where(n > 0, n, 1))
        return pd.Series(out, dtype=object)

    new = chunks.join(have.select(id_col), id_col, "left_anti")
    return new.withColumn("vector", embed(text_col)).drop(text_col)


def ingest(wanted: DataFrame, have: DataFrame, key: str, fetch: Callable[[str], bytes]) -> DataFrame:
    """What is wanted and not there, fetched: key, content, sha256, error. A failure is a row, never the end of the run."""

    def one(batches):
        for b in batches:
            rows = []
            for k in b[key]:
                try:
                    rows.append((k, fetch(k), None))
                except Exception as e:  # noqa: BLE001  the error is the result
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "content", "error"])

    new = wanted.select(key).distinct().join(have.select(key), key, "left_anti")
    got = new.mapInPandas(one, f"{key} string, content binary, error string")
    return got.select(key, "content", F.sha2("content", 256).alias("sha256"), "error")


def run_questions(questions: DataFrame, answer: Callable[[dict], dict], schema: str, id_col: str = "qid") -> DataFrame:
    """``answer`` on every question (a dict in, a dict of ``schema``'s columns out) with error and seconds columns."""
    import time

    names = [f.split()[0] for f in schema.split(", ")]

    def one(batches):
        for b in batches:
            rows = []
            for q in b.to_dict("records"):
                began = time.time()
                try:
                    got, error = answer(q), ""
                except Exception as e:  # noqa: BLE001  the error is the result
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append((q[id_col], *[got.get(n) for n in names], error, time.time() - began))
            yield pd.DataFrame(rows, columns=[id_col, *names, "error", "seconds"])

    kind = dict(questions.dtypes)[id_col]
    return questions.mapInPandas(one, f"{id_col} {kind}, {schema}, error string, seconds double")


def write_results(folder: str, name: str, results: dict, markdown: str, partial: bool = False) -> str:
    """A run's results as JSON and Markdown; a partial run never takes the name of a full one."""
    stem = f"{folder}/{name}{'-partial' if partial else ''}"
    with open(f"{stem}.json", "w", encoding="utf-8", newline="\n") as f:
        json.dump(results, f, ensure_ascii=False, indent=1, sort_keys=True)
    with open(f"{stem}.md", "w", encoding="utf-8", newline="\n") as f:
        f.write(markdown)
    return stem

