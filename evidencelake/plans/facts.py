"""Queries over facts, metrics and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import evals, facts, gates, lookup, metrics
from evidencelake.plans import fixtures as X
from evidencelake.sources import manifest, xbrl
from evidencelake.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FACT = ["cik", "ticker", "tag", "unit", "period_start", "period_end", "span", "val", "accn", "form", "filed"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _current(spark, d):
    return facts.current(X.facts(spark, d), X.TIES)


def _resolved(spark, d):
    cur = _current(spark, d)
    return cur, metrics.resolve_tags(metrics.candidates(cur, metrics.tag_table(spark, X.METRICS)))


def _mfacts(spark, d):
    cur, res = _resolved(spark, d)
    return metrics.metric_facts(cur, res, metrics.registry_table(spark, X.METRICS))


def _wide(spark, d):
    return metrics.wide(_mfacts(spark, d), X.METRICS)


@query(f"WITH {X.FACTS} SELECT span, period_type, count(*) AS n FROM facts GROUP BY ALL")
def span_histogram(spark, d):
    return facts.histogram(X.facts(spark, d), "span", "period_type")


@query(f"WITH {X.CURRENT} SELECT {', '.join(FACT)} FROM cur")
def facts_current(spark, d):
    return _current(spark, d).select(*FACT)


@query(f"""WITH {X.FACTS}, k AS (SELECT *, (filed, accn, val, l_linenumber, l_partkey, l_suppkey) AS key FROM facts)
SELECT cik, ticker, taxonomy, tag, unit, period_start, period_end, span, count(DISTINCT val) AS n_values, min(filed) AS first_filed, max(filed) AS last_filed,
  arg_min(val, key) AS first_val, arg_max(val, key) AS last_val, arg_max(val, key) - arg_min(val, key) AS delta
FROM k GROUP BY ALL HAVING count(DISTINCT val) > 1""")  # fmt: skip
def restatements(spark, d):
    return facts.restatements(X.facts(spark, d), X.TIES)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return facts.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"WITH {X.RESOLVED} SELECT cik, ticker, metric, tag, priority, n_facts, first_period, last_period FROM cand")
def tag_candidates(spark, d):
    return metrics.candidates(_current(spark, d), metrics.tag_table(spark, X.METRICS)).drop("resolve_by")


@query(f"WITH {X.RESOLVED} SELECT * FROM res")
def tag_resolution(spark, d):
    return _resolved(spark, d)[1]


@query(f"WITH {X.RESOLVED} SELECT metric, label, resolution_rank, {', '.join(FACT)} FROM mf")
def metric_facts(spark, d):
    return _mfacts(spark, d).select("metric", "label", "resolution_rank", *FACT)


@query(f"WITH {X.WIDE} SELECT * FROM wide")
def annual_pivot(spark, d):
    return _wide(spark, d)


_OWED = "coalesce(liabilities, assets - coalesce(equity_incl_nci, equity + coalesce(minority_interest, 0)) - coalesce(temporary_equity, 0))"
_RATIOS = f"""{X.WIDE},
annual AS (SELECT * EXCLUDE (gross_profit, liabilities), gross_profit AS gross_profit_tagged, liabilities AS liabilities_tagged,
  coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit, {_OWED} AS liabilities, operating_cash_flow - capex AS free_cash_flow,
  coalesce(gross_profit, revenue - cost_of_revenue) / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin,
  net_income / nullif(revenue, 0) AS net_margin, net_income / nullif(equity, 0) AS return_on_equity, net_income / nullif(assets, 0) AS return_on_assets,
  {_OWED} / nullif(equity, 0) AS debt_to_equity, revenue / nullif(lag(revenue) OVER w, 0) - 1 AS revenue_yoy, net_income / nullif(lag(net_income) OVER w, 0) - 1 AS net_income_yoy,
  lag(period_end) OVER w AS prior_period_end FROM wide WINDOW w AS (PARTITION BY cik ORDER BY period_end, period_start))"""


@query(f"WITH {_RATIOS} SELECT * FROM annual")
def annual_ratios_yoy(spark, d):
    return metrics.ratios(_wide(spark, d))


@query(f"""WITH {X.WIDE}, k AS (SELECT *, (period_end, period_start) AS key FROM wide WHERE revenue IS NOT NULL),
g AS (SELECT cik, ticker, min(period_end) AS from_period, max(period_end) AS to_period, count(*) AS years, date_diff('day', min(period_end), max(period_end)) / 365.25 AS span_years,
  arg_min(revenue, key) AS revenue_first, arg_max(revenue, key) AS revenue_last, arg_min(net_income, key) AS a, arg_max(net_income, key) AS b FROM k GROUP BY cik, ticker)
SELECT * EXCLUDE (a, b, span_years), CAST(span_years AS DOUBLE) AS span_years,
  round(pow(revenue_last / nullif(revenue_first, 0), 1.0 / nullif(CAST(span_years AS DOUBLE), 0)) - 1, 6) AS revenue_cagr, round(pow(b / nullif(a, 0), 1.0 / nullif(CAST(span_years AS DOUBLE), 0)) - 1, 6) AS net_income_cagr FROM g""")  # fmt: skip
def growth_cagr(spark, d):
    g = metrics.growth(_wide(spark, d))
    return g.withColumns({c: F.round(c, 6) for c in ("revenue_cagr", "net_income_cagr")})


@query(f"""WITH {_RATIOS}, last AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC, period_start DESC) AS rn FROM annual WHERE revenue_yoy IS NOT NULL)
SELECT ticker, period_end, revenue, revenue_yoy FROM last WHERE rn = 1 ORDER BY revenue_yoy DESC, ticker LIMIT 5""")  # fmt: skip
def top_growth(spark, d):
    from pyspark.sql import Window

    a = metrics.ratios(_wide(spark, d)).filter("revenue_yoy is not null")
    w = Window.partitionBy("cik").orderBy(F.desc("period_end"), F.desc("period_start"))
    last = a.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return last.orderBy(F.desc("revenue_yoy"), "ticker").limit(5).select("ticker", "period_end", "revenue", "revenue_yoy")


_PRIMARY = f"{X.RESOLVED}, prim AS (SELECT * FROM res WHERE resolution_rank = 1)"


@query(f"""WITH {_PRIMARY} SELECT reg.metric, count(prim.cik) AS companies, reg.universal, reg.derive IS NOT NULL AS derivable
FROM reg LEFT JOIN prim ON prim.metric = reg.metric WHERE reg.tags <> '' GROUP BY reg.metric, reg.universal, reg.derive""")  # fmt: skip
def metric_coverage(spark, d):
    return metrics.coverage(metrics.registry_table(spark, X.METRICS), metrics.primary_tags(_resolved(spark, d)[1]))


@query(f"""WITH {_PRIMARY}, {X.COMPANY_ROWS} SELECT reg.metric, count(*) AS n_missing, string_agg(co.ticker, ', ' ORDER BY co.ticker) AS tickers
FROM reg CROSS JOIN co LEFT JOIN prim ON prim.metric = reg.metric AND prim.cik = co.cik AND prim.n_facts >= 20 WHERE reg.tags <> '' AND prim.cik IS NULL GROUP BY reg.metric""")  # fmt: skip
def metric_gaps(spark, d):
    prim = metrics.primary_tags(_resolved(spark, d)[1]).filter("n_facts >= 20")
    return metrics.gaps(metrics.registry_table(spark, X.METRICS), X.companies(spark, d), prim)


@query(f"WITH {X.RESOLVED}, {X.COMPANY_ROWS} SELECT cik, ticker FROM co WHERE NOT EXISTS (SELECT 1 FROM mf WHERE mf.cik = co.cik AND mf.metric = 'net_income' AND mf.span = 'FY')")
def absence_anti_join(spark, d):
    return metrics.without_metric(X.companies(spark, d), _mfacts(spark, d).filter("span = 'FY'"), "net_income")


@query(f"""WITH {X.FACTS}, g AS (SELECT ticker, accn, period_end, max(CASE WHEN tag = 'LARGE' THEN val END) AS total, max(CASE WHEN tag = 'MEDIUM' THEN val END) AS p0,
  max(CASE WHEN tag = 'SMALL' THEN val END) AS p1, max(CASE WHEN tag LIKE 'PRO%' THEN val END) AS extra FROM facts GROUP BY ticker, accn, period_end)
SELECT ticker, accn, period_end, total, total - coalesce(p0, 0) - coalesce(p1, 0) - coalesce(extra, 0) AS gap FROM g
WHERE total IS NOT NULL AND p0 IS NOT NULL AND abs(total - coalesce(p0, 0) - coalesce(p1, 0) - coalesce(extra, 0)) > 0.005 * abs(total)""")  # fmt: skip
def identity_violations(spark, d):
    return facts.balance_violations(X.facts(spark, d), "LARGE", ["MEDIUM", "SMALL"], "PRO")


def _payloads(spark, d):
    return table(spark, d, "customer").select(F.lpad((F.col("c_custkey") % X.COMPANIES).cast("string"), 10, "0").alias("cik"), F.col("c_custkey").alias("n_concepts"), (F.col("c_custkey") * 7).alias("bytes"))


_PAY = f"pay AS (SELECT lpad(CAST(c_custkey % {X.COMPANIES} AS VARCHAR), 10, '0') AS cik, c_custkey AS n_concepts, c_custkey * 7 AS bytes FROM customer)"


@query(f"""WITH {X.COMPANY_ROWS}, {X.FILINGS}, {_PAY} SELECT (SELECT count(*) FROM co) AS companies, count(*) AS filings, count(DISTINCT cik) AS companies_with_filings,
  CAST(coalesce(sum(bytes), 0) AS BIGINT) AS filing_bytes, (SELECT count(*) FROM pay) AS companyfacts, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM pay) AS facts_bytes FROM fil""")  # fmt: skip
def manifest_stats(spark, d):
    return manifest.stats(X.companies(spark, d), X.filings(spark, d), _payloads(spark, d))


@query(f"""WITH {X.COMPANY_ROWS}, {X.FILINGS}, {_PAY}, f AS (SELECT cik, count(*) FILTER (WHERE form = '10-K') AS n_10k, count(*) FILTER (WHERE form = '10-Q') AS n_10q,
  min(period_end) AS first_period, max(period_end) AS last_period, CAST(sum(bytes) AS BIGINT) AS filing_bytes FROM fil GROUP BY cik), p AS (SELECT cik, CAST(sum(n_concepts) AS BIGINT) AS n_concepts FROM pay GROUP BY cik)
SELECT co.cik, co.ticker, coalesce(n_10k, 0) AS n_10k, coalesce(n_10q, 0) AS n_10q, first_period, last_period, coalesce(filing_bytes, 0) AS filing_bytes, coalesce(n_concepts, 0) AS n_concepts
FROM co LEFT JOIN f USING (cik) LEFT JOIN p USING (cik)""")  # fmt: skip
def manifest_per_company(spark, d):
    return manifest.per_company(X.companies(spark, d), X.filings(spark, d), _payloads(spark, d))


@query(f"WITH {X.FILINGS} SELECT accn, cik, form, period_end FROM fil WHERE cik IN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') FROM nation)")
def manifest_prune(spark, d):
    keep = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"))
    return manifest.prune(X.filings(spark, d), keep).select("accn", "cik", "form", "period_end")


@query(f"""WITH {X.FILINGS}, old AS (SELECT * FROM fil WHERE form = '10-K'), new AS (SELECT accn, cik, 'new' AS form, period_end, bytes + 1 AS bytes, sha256, path || '.v2' AS path FROM fil WHERE bytes % 2 = 0)
SELECT coalesce(old.accn, new.accn) AS accn, CASE WHEN old.accn IS NULL THEN new.cik ELSE old.cik END AS cik, CASE WHEN old.accn IS NULL THEN new.form ELSE old.form END AS form,
  CASE WHEN old.accn IS NULL THEN new.period_end ELSE old.period_end END AS period_end, CASE WHEN new.accn IS NULL THEN old.bytes ELSE new.bytes END AS bytes,
  CASE WHEN new.accn IS NULL THEN old.sha256 ELSE new.sha256 END AS sha256, CASE WHEN new.accn IS NULL THEN old.path ELSE new.path END AS path FROM old FULL JOIN new ON old.accn = new.accn""")  # fmt: skip
def manifest_upsert(spark, d):
    f = X.filings(spark, d)
    new = f.filter("bytes % 2 = 0").withColumn("form", F.lit("new")).withColumn("bytes", F.col("bytes") + 1).withColumn("path", F.concat("path", F.lit(".v2")))
    return manifest.upsert(f.filter("form = '10-K'"), new, "accn", ["path", "bytes", "sha256"])


def _asked(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("qid"), F.concat(F.lit("c"), (F.col("c_custkey") % X.COMPANIES).cast("string")).alias("ticker"), F.lit("us-gaap").alias("taxonomy"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "PROMO").otherwise("LARGE").alias("tag"), F.lit("USD").alias("unit"),
        F.when(F.col("c_custkey") % 3 > 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2400).cast("int"))).alias("target"),
    )


_ASKED = f"""asked AS (SELECT c_custkey AS qid, 'C' || CAST(c_custkey % {X.COMPANIES} AS VARCHAR) AS ticker, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PROMO' ELSE 'LARGE' END AS tag, 'USD' AS unit,
  CASE WHEN c_custkey % 3 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 2400 AS INTEGER) END AS target FROM customer)"""
_BEST = "row_number() OVER (PARTITION BY qid ORDER BY abs(cur.period_end - target) NULLS LAST, cur.period_end DESC, {ties}) AS rn"
_KEYS = ("val", "accn", "l_linenumber", "period_start")


@query(f"""WITH {X.CURRENT}, {X.FILINGS}, {_ASKED}, con AS (SELECT DISTINCT tag, lower(tag) || ' goods' AS label FROM cur WHERE tag <> 'PROMO'),
r AS (SELECT qid, cur.ticker, cur.tag, coalesce(con.label, cur.tag) AS label, cur.unit, cur.span, cur.period_start, cur.period_end, cur.val, cur.accn, fil.form, target,
  {_BEST.format(ties="cur.val DESC, cur.accn DESC, l_linenumber DESC, cur.period_start DESC NULLS LAST")} FROM asked JOIN cur USING (ticker, tag, unit) JOIN fil USING (accn) LEFT JOIN con ON con.tag = cur.tag)
SELECT * EXCLUDE (rn, target) FROM r WHERE rn = 1 AND (target IS NULL OR abs(period_end - target) <= 6)""")  # fmt: skip
def nearest_period_lookup(spark, d):
    cur = _current(spark, d)
    con = cur.filter("tag <> 'PROMO'").select("taxonomy", "tag", F.concat(F.lower("tag"), F.lit(" goods")).alias("label")).distinct()
    return lookup.lookup(_asked(spark, d), cur, X.filings(spark, d), con, _KEYS)


@query(f"""WITH {X.CURRENT}, {_ASKED}, r AS (SELECT qid, cur.ticker, tag, unit, cur.period_end, cur.val, cur.accn, target,
  {_BEST.format(ties="cur.val DESC, cur.accn DESC, l_linenumber DESC, cur.period_start DESC NULLS LAST")} FROM asked JOIN cur USING (ticker, tag, unit))
SELECT * EXCLUDE (rn, target) FROM r WHERE rn = 1 AND (target IS NULL OR abs(period_end - target) <= 6)""")  # fmt: skip
def recheck_fact(spark, d):
    return lookup.recheck(_asked(spark, d).withColumn("accn", F.lit("")), _current(spark, d), _KEYS)


@query(f"""WITH {X.FACTS} SELECT md5('s|' || accn || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS h, accn, l_linenumber, l_partkey, l_suppkey, tag, val
FROM facts ORDER BY h, accn, l_linenumber, l_partkey, l_suppkey LIMIT 25""")  # fmt: skip
def fact_sample_md5(spark, d):
    f = X.facts(spark, d).select("accn", "l_linenumber", "l_partkey", "l_suppkey", "tag", "val")
    return evals.md5_sample(f, ["accn", "l_linenumber", "l_partkey", "l_suppkey"], 25, "s").select("h", "accn", "l_linenumber", "l_partkey", "l_suppkey", "tag", "val")


@query(f"WITH {X.WIDE} SELECT cik, period_end, period_start, revenue AS a, round(revenue * 1.5, 9) AS b FROM wide WHERE revenue IS NOT NULL AND CAST(cik AS INTEGER) % 2 = 1")
def derivation_crosscheck(spark, d):
    """The pivot's revenue against one worked out from the metrics' rows, which is off for every second company."""
    m = _mfacts(spark, d)
    mine = m.filter("metric = 'revenue' AND span = 'FY'").groupBy("cik", "period_end").agg(F.max("val").alias("revenue"))
    years = metrics.fiscal_years(m).select("cik", F.col("fiscal_end").alias("period_end"), F.col("fiscal_start").alias("period_start"))
    off = F.when(F.col("cik").cast("int") % 2 == 1, 1.5).otherwise(1.0)
    again = years.join(mine, ["cik", "period_end"], "left").withColumn("revenue", F.col("revenue") * off)
    got = evals.numeric_crosscheck(_wide(spark, d), again, ("cik", "period_end", "period_start"), "revenue")
    return got.withColumn("b", F.round("b", 9))


@query("""WITH f AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cik, l_linestatus AS unit, CAST(o_orderdate AS DATE) AS period_start, CAST(l_shipdate AS DATE) AS period_end, l_extendedprice AS val,
  CAST(l_suppkey AS VARCHAR) AS accn, p_type AS tag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT cik, tag, unit, period_start, period_end, CAST(period_end - period_start + 1 AS INTEGER) AS period_days, CASE WHEN period_end - period_start + 1 BETWEEN 66 AND 116 THEN 'Q' WHEN period_end - period_start + 1 BETWEEN 157 AND 207 THEN 'H'
  WHEN period_end - period_start + 1 BETWEEN 248 AND 298 THEN '9M' WHEN period_end - period_start + 1 BETWEEN 340 AND 390 THEN 'FY' ELSE 'other' END AS span, val, accn FROM f WHERE unit <> 'F' OR val <= 50000""")  # fmt: skip
def xbrl_flatten(spark, d):
    """Orders as nested payloads, flattened again; values over 50,000 in one unit are text and skipped."""
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    val = F.when((F.col("l_linestatus") == "F") & (F.col("l_extendedprice") > 50000), "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    entry = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("start"), F.col("l_shipdate").cast("date").cast("string").alias("end"), val.alias("val"), F.col("l_suppkey").cast("string").alias("accn"), F.lit("2001-01-01").alias("filed"))
    u = j.groupBy("o_orderkey", "p_type", "l_linestatus").agg(F.collect_list(entry).alias("entries"))
    t = u.groupBy("o_orderkey", "p_type").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "entries"))).alias("units"))
    c = t.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("p_type", F.struct("units")))).alias("tags"))
    pay = c.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("cik"), F.lit("T").alias("ticker"), F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "tags").alias("facts"))).alias("payload"))
    return xbrl.facts(pay).select("cik", "tag", "unit", "period_start", "period_end", "period_days", "span", "val", "accn")


@query(f"""WITH {X.FACTS}, {X.COMPANY_ROWS}, {X.FILINGS}, t AS (SELECT count(*) AS n FROM fil), few AS (SELECT count(*) AS n FROM (SELECT co.cik FROM co LEFT JOIN fil USING (cik) GROUP BY co.cik HAVING count(accn) < 10)),
odd AS (SELECT count(*) AS n FROM fil WHERE bytes % 1000 = 7), dup AS (SELECT count(*) AS n FROM (SELECT 1 FROM facts GROUP BY cik, taxonomy, tag, unit, period_start, period_end, accn HAVING count(*) > 1))
SELECT 'corpus size' AS "check", n >= 1000 AS ok, CAST(n AS VARCHAR) || ' of at least 1000' AS detail FROM t UNION ALL SELECT 'manifest matches disk', n = 0, CAST(n AS VARCHAR) || ' rows' FROM odd
UNION ALL SELECT 'payload for every company', true, '0 rows' UNION ALL SELECT 'filings for every company', n = 0, CAST(n AS VARCHAR) || ' rows' FROM few UNION ALL SELECT 'identities are unique', n = 0, CAST(n AS VARCHAR) || ' rows' FROM dup""")
def data_gates(spark, d):
    f = X.filings(spark, d)
    listing = f.filter("bytes % 1000 <> 7").select("path")
    c = gates.corpus(X.companies(spark, d), f, _payloads(spark, d), listing, least=1000, per_company=10)
    return gates.every(c, gates.none_of("identities are unique", facts.duplicate_keys(X.facts(spark, d), *facts.IDENTITY, "accn")))


@query("""WITH g AS (SELECT c_mktsegment AS question, max(c_acctbal) AS v, min(c_acctbal) AS w FROM customer GROUP BY 1)
SELECT question, v AS expected, CASE WHEN question = 'MACHINERY' THEN v * 1.02 WHEN question <> 'BUILDING' THEN v * 1.001 END AS got, question NOT IN ('MACHINERY', 'BUILDING') AS ok FROM g""")
def expected_values(spark, d):
    """Answers judged against the values they should have."""
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("question")).agg(F.max("c_acctbal").alias("v"))
    got = g.filter("question <> 'BUILDING'").select("question", F.when(F.col("question") == "MACHINERY", F.col("v") * 1.02).otherwise(F.col("v") * 1.001).alias("got"))
    return gates.judge(got, g.select("question", F.col("v").alias("expected")))
