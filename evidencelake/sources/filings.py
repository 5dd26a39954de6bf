"""Filing indexes, the company universe and filed documents as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from evidencelake.functions import text as T

INDEX = "accn string, form string, filed string, period string, doc string, size long"
# Fixed value: the parallel arrays of a filing index, and what they become.
ARRAYS = {"accessionNumber": "accn", "form": "form", "filingDate": "filed", "reportDate": "period", "primaryDocument": "doc", "size": "size"}


def universe(spark: SparkSession, spec: dict) -> tuple[DataFrame, list[str], tuple[str, str]]:
    """(companies, forms, window) of a parsed declaration. Missing parts and repeated tickers are errors; tickers are upper-cased, ciks padded."""
    for part in ("companies", "forms", "window"):
        if not spec.get(part):
            raise ValueError(f"the universe has no {part}")
    rows = [(str(c["ticker"]).upper(), c.get("name"), c.get("sector"), str(c["cik"]).zfill(10) if c.get("cik") else None) for c in spec["companies"]]
    twice = {t for t in (r[0] for r in rows) if [r[0] for r in rows].count(t) > 1}
    if twice:
        raise ValueError(f"declared twice: {', '.join(sorted(twice))}")
    w = spec["window"]
    return spark.createDataFrame(rows, "ticker string, name string, sector string, cik string"), list(spec["forms"]), (str(w["from"]), str(w["to"]))


def read_universe(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], tuple[str, str]]:
    """``universe`` of a declaration on disk: JSON, or YAML where a parser of it is installed. A short, hand-made file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is not JSON, and there is no YAML parser") from e
        spec = yaml.safe_load(text)
    if not isinstance(spec, dict):
        raise ValueError(f"{path} declares no universe")
    return universe(spark, spec)


def resolve_ciks(companies: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """A declared cik wins, others come from ``ticker_map`` (ticker, cik)."""
    m = ticker_map.select(F.upper("ticker").alias("ticker"), T.cik10(F.col("cik").cast("string")).alias("_cik"))
    return companies.join(m, "ticker", "left").withColumn("cik", F.coalesce("cik", "_cik")).drop("_cik")


def unresolved(companies: DataFrame) -> list[str]:
    """Tickers without a cik, all at once; the universe is a short, declared list."""
    return [r.ticker for r in companies.filter("cik is null").select("ticker").orderBy("ticker").collect()]


def resolved(companies: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """``resolve_ciks``, or an error that names every ticker without a cik."""
    out = resolve_ciks(companies, ticker_map)
    if lost := unresolved(out):
        raise LookupError(f"no cik for {', '.join(lost)}")
    return out


def ticker_map(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    """ticker, cik, title of one object of objects."""
    entry = F.explode(F.map_values(F.from_json(json_col, "map<string,struct<cik_str:long,ticker:string,title:string>>"))).alias("e")
    return payload.select(entry).select(F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), "e.title")


def zip_index(blocks: DataFrame, *keep: str) -> DataFrame:
    """Parallel arrays as rows; arrays of different lengths raise."""
    lengths = F.array_distinct(F.array(*[F.size(a) for a in ARRAYS]))
    zipped = F.arrays_zip(*[F.col(a) for a in ARRAYS])
    checked = F.when(F.size(lengths) == 1, zipped).otherwise(F.raise_error(F.lit("an index's arrays differ in length")))
    x = blocks.select(*keep, F.explode(checked).alias("r"))
    return x.select(*keep, *[F.col(f"r.{a}").alias(n) for a, n in ARRAYS.items()])


def select_filings(index: DataFrame, forms: list[str], first: str, last: str) -> DataFrame:
    """Filings of the forms with a report date in the window and a document, the latest first."""
    return index.filter(F.col("form").isin(*forms) & F.col("period").between(first, last) & (F.coalesce("doc", F.lit("")) != "")).orderBy(F.desc("period"), F.desc("form"), "accn")


class SubmissionsSource(DataSource):
    """Filing indexes of companies from JSON files, one partition for each chunk.

    Options: ``main`` (path of a company's index with ``filings.recent`` and
    ``filings.files``) and ``folder`` for the chunks it names. A filter
    ``filed >= x`` reaches the source: chunks whose last filing is earlier are
    never opened.
    """

    @classmethod
    def name(cls) -> str:
        return "filing_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema):
        return _SubmissionsReader(self.options)


class _Chunk(InputPartition):
    def __init__(self, path: str, inline: str | None):
        self.path, self.inline = path, inline


class _SubmissionsReader(DataSourceReader):
    def __init__(self, options):
        self.main, self.folder, self.since = options["main"], options.get("folder", ""), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.attribute == ("filed",):
                self.since = max(self.since or "", str(f.value))
            yield f  # Spark checks rows as well

    def partitions(self):
        with open(self.main, encoding="utf-8") as f:
            filings = json.load(f)["filings"]
        out = [_Chunk("", json.dumps(filings["recent"]))]
        for c in filings.get("files", ()):
            if self.since is None or c["filingTo"] >= self.since:
                out.append(_Chunk(f"{self.folder}/{c['name']}", None))
        return out

    def read(self, part):
        if part.inline is None:
            with open(part.path, encoding="utf-8") as f:
                block = json.load(f)
        else:
            block = json.loads(part.inline)
        yield from zip(*[block[a] for a in ARRAYS], strict=True)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Filed documents: path, bytes, sha256 as served, text with bad bytes replaced."""
    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", errors="replace"))

    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), decode("content").alias("text"))
