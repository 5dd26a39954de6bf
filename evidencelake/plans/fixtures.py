"""The driver's tables in the shapes the operators take.

Orders and their lines stand for reported facts: a group of customers is a
company, a part's type a tag, the month of shipping the end of a period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import spans
from evidencelake.operators.metrics import Metric
from evidencelake.tables import table

COMPANIES = 50
#: Every line of a filing that could tie, so that windows are total.
TIES = ("val", "l_linenumber", "l_partkey", "l_suppkey")

METRICS = (
    Metric("revenue", "Revenue", "flow", "USD", ("LARGE", "MEDIUM")),
    Metric("cost_of_revenue", "Cost of revenue", "flow", "USD", ("SMALL",), universal=False),
    Metric("gross_profit", "Gross profit", "flow", "USD", ("PROMO",), derive="revenue - cost_of_revenue"),
    Metric("operating_income", "Operating income", "flow", "USD", ("ECONOMY",), universal=False),
    Metric("net_income", "Net income", "flow", "USD", ("STANDARD", "ECONOMY")),
    Metric("operating_cash_flow", "Cash from operations", "flow", "shares", ("LARGE",)),
    Metric("capex", "Capital expenditure", "flow", "shares", ("SMALL", "MEDIUM"), universal=False),
    Metric("free_cash_flow", "Free cash flow", "flow", "USD", (), derive="operating_cash_flow - capex"),
    Metric("assets", "Total assets", "stock", "USD", ("LARGE",)),
    Metric("liabilities", "Total liabilities", "stock", "USD", ("PROMO",)),
    Metric("equity", "Shareholders equity", "stock", "USD", ("MEDIUM", "SMALL"), resolve_by="priority"),
    Metric("equity_incl_nci", "Total equity", "stock", "USD", ("SMALL",), universal=False),
    Metric("minority_interest", "Noncontrolling interests", "stock", "shares", ("ECONOMY",), universal=False),
    Metric("temporary_equity", "Temporary equity", "stock", "shares", ("STANDARD",), universal=False),
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    day = F.col("o_orderdate").cast("date")
    opened, end = F.trunc(day, "month"), F.last_day(F.col("l_shipdate").cast("date"))
    start = F.when((F.col("l_returnflag") != "N") & (opened <= end), opened)
    days = spans.period_days(start, end)
    n = (F.col("o_custkey") % COMPANIES).cast("string")
    return j.select(
        F.lpad(n, 10, "0").alias("cik"), F.concat(F.lit("C"), n).alias("ticker"), F.lit("us-gaap").alias("taxonomy"), F.col("p_type").alias("tag"),
        F.when(F.col("l_linestatus") == "O", "USD").otherwise("shares").alias("unit"), start.alias("period_start"), end.alias("period_end"),
        spans.period_type(start).alias("period_type"), days.alias("period_days"), spans.classify(days).alias("span"), F.col("l_extendedprice").alias("val"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("accn"), F.concat(F.lit("10-"), "l_returnflag").alias("form"), F.date_add(day, F.col("l_linenumber")).alias("filed"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


FACTS = f"""facts AS (
  SELECT lpad(CAST(o_custkey % {COMPANIES} AS VARCHAR), 10, '0') AS cik, 'C' || CAST(o_custkey % {COMPANIES} AS VARCHAR) AS ticker, 'us-gaap' AS taxonomy, p_type AS tag,
    CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'shares' END AS unit, period_start, period_end,
    CASE WHEN period_start IS NULL THEN 'instant' ELSE 'duration' END AS period_type, CAST(period_end - period_start + 1 AS INTEGER) AS period_days,
    CASE WHEN period_start IS NULL THEN 'instant' WHEN period_end - period_start + 1 BETWEEN 66 AND 116 THEN 'Q' WHEN period_end - period_start + 1 BETWEEN 157 AND 207 THEN 'H'
         WHEN period_end - period_start + 1 BETWEEN 248 AND 298 THEN '9M' WHEN period_end - period_start + 1 BETWEEN 340 AND 390 THEN 'FY' ELSE 'other' END AS span,
    l_extendedprice AS val, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accn, '10-' || l_returnflag AS form, CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) AS filed,
    l_linenumber, l_partkey, l_suppkey
  FROM (SELECT *, last_day(CAST(l_shipdate AS DATE)) AS period_end,
          CASE WHEN l_returnflag <> 'N' AND date_trunc('month', o_orderdate) <= last_day(CAST(l_shipdate AS DATE)) THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS period_start
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey))"""

CURRENT = (
    FACTS
    + """,
cur AS (SELECT DISTINCT ON (cik, taxonomy, tag, unit, period_start, period_end) * FROM facts
  ORDER BY filed DESC, accn DESC, val DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC)"""
)


def _sql_rows(rows) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


_TAGS = _sql_rows([(m.name, m.label, m.kind, m.unit, m.period_type, m.resolve_by, t, i) for m in METRICS for i, t in enumerate(m.tags)])
_REGISTRY = _sql_rows([(m.name, m.label, m.unit, ", ".join(m.tags), m.derive or None, m.universal) for m in METRICS])

# Ranks are counted, not numbered by a window: a tag's is one more than the tags of its metric that go before it.
RESOLVED = (
    CURRENT
    + f""",
tagt AS (SELECT * FROM (VALUES {_TAGS}) AS t(metric, label, kind, unit, period_type, resolve_by, tag, priority)),
reg AS (SELECT * FROM (VALUES {_REGISTRY}) AS t(metric, label, unit, tags, derive, universal)),
use AS (SELECT c.*, t.metric, t.label, t.priority, t.resolve_by FROM tagt t JOIN cur c ON (c.tag, c.unit, c.period_type) = (t.tag, t.unit, t.period_type) AND c.span <> 'other'),
cand AS (SELECT cik, any_value(ticker) AS ticker, metric, tag, priority, count(val) AS n_facts, min(period_end) AS first_period, max(period_end) AS last_period,
    row(if(any_value(resolve_by) = 'priority', priority, 0), -count(val), priority, tag) AS place FROM use GROUP BY cik, metric, tag, priority),
res AS (SELECT * EXCLUDE (place), CAST(1 + (SELECT count(*) FROM cand o WHERE o.cik = cand.cik AND o.metric = cand.metric AND o.place < cand.place) AS INTEGER) AS resolution_rank FROM cand),
mu AS (SELECT cur.*, res.metric, reg.label, res.resolution_rank FROM res JOIN reg USING (metric) JOIN cur ON (cur.cik, cur.tag, cur.unit) = (res.cik, res.tag, reg.unit) AND cur.span <> 'other'),
mf AS (SELECT mu.* FROM mu WHERE NOT EXISTS (SELECT 1 FROM mu o WHERE o.cik = mu.cik AND o.metric = mu.metric AND o.span = mu.span AND o.period_end = mu.period_end
    AND o.period_start IS NOT DISTINCT FROM mu.period_start AND o.resolution_rank < mu.resolution_rank)),
fy AS (SELECT cik, period_end AS fiscal_end, period_start AS fiscal_start FROM mf GROUP BY ALL HAVING bool_or(span = 'FY'))"""
)

_NAMED = ", ".join(f"'{m.name}'" for m in METRICS if m.tags)
_STOCKS = ", ".join(f"'{m.name}'" for m in METRICS if m.kind == "stock")
WIDE = RESOLVED + f""",
yearly AS (SELECT fy.cik, ticker, fiscal_end AS period_end, fiscal_start AS period_start, if(span = if(metric IN ({_STOCKS}), 'instant', 'FY'), metric, NULL) AS metric, val
  FROM fy JOIN mf ON mf.cik = fy.cik AND mf.period_end = fiscal_end),
wide AS (FROM (PIVOT yearly ON metric IN ({_NAMED}) USING max(val) GROUP BY cik, ticker, period_end, period_start))"""  # fmt: skip


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("c_custkey") % COMPANIES).cast("string")
    return table(spark, sf_dir, "customer").select(F.lpad(n, 10, "0").alias("cik"), F.concat(F.lit("C"), n).alias("ticker")).distinct()


COMPANY_ROWS = f"co AS (SELECT DISTINCT lpad(CAST(c_custkey % {COMPANIES} AS VARCHAR), 10, '0') AS cik, 'C' || CAST(c_custkey % {COMPANIES} AS VARCHAR) AS ticker FROM customer)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filed documents."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accn"), F.lpad((F.col("o_custkey") % COMPANIES).cast("string"), 10, "0").alias("cik"),
        F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"), F.col("o_orderdate").cast("date").alias("period_end"),
        (F.col("o_totalprice") * 100).cast("long").alias("bytes"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"), F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string")).alias("path"),
    )


FILINGS = f"""fil AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accn, lpad(CAST(o_custkey % {COMPANIES} AS VARCHAR), 10, '0') AS cik,
  CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form, CAST(o_orderdate AS DATE) AS period_end, CAST(trunc(o_totalprice * 100) AS BIGINT) AS bytes,
  md5(CAST(o_orderkey AS VARCHAR)) AS sha256, 'raw/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders)"""
