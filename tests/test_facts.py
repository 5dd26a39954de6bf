"""Facts, metrics, lookups, payloads and the manifest on literal rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import spans
from evidencelake.operators import facts, lookup, metrics
from evidencelake.sources import filings, manifest, xbrl

D = dt.date.fromisoformat
FACT = "cik string, ticker string, taxonomy string, tag string, unit string, period_start date, period_end date, val double, accn string, filed date"


def table(spark, rows):
    df = spark.createDataFrame([("1", "T", "us-gaap", *r) for r in rows], FACT)
    days = spans.period_days(F.col("period_start"), F.col("period_end"))
    return df.withColumn("span", spans.classify(days)).withColumn("period_type", spans.period_type(F.col("period_start")))


def test_current_and_restatements(spark):
    y, e = D("2023-01-01"), D("2023-12-31")
    df = table(spark, [("A", "USD", y, e, 10.0, "a1", D("2024-02-01")), ("A", "USD", y, e, 12.0, "a2", D("2025-02-01")), ("C", "USD", None, e, 5.0, "a1", D("2024-02-01")), ("C", "USD", None, e, 5.0, "a2", D("2025-02-01")), ("A", "EUR", y, e, 1.0, "a1", D("2024-02-01"))])
    assert sorted((r.tag, r.unit, r.val, r.accn) for r in facts.current(df).collect()) == [("A", "EUR", 1.0, "a1"), ("A", "USD", 12.0, "a2"), ("C", "USD", 5.0, "a2")]
    (r,) = facts.restatements(df).collect()
    assert (r.tag, r.n_values, r.first_val, r.last_val, r.delta) == ("A", 2, 10.0, 12.0, 2.0)
    assert facts.duplicate_keys(df, *facts.IDENTITY, "accn").count() == 0
    assert [r.n for r in facts.duplicate_keys(df, *facts.IDENTITY).orderBy("tag").collect()] == [2, 2]


def test_resolution_by_coverage_and_priority(spark):
    ys = [(D(f"{y}-01-01"), D(f"{y}-12-31")) for y in range(2015, 2020)]
    f = D("2021-01-01")
    rows = [("Old", "USD", *ys[i], 1.0 + i, "a", f) for i in range(5)] + [("New", "USD", *ys[4], 99.0, "b", f)]
    rows += [("P", "USD", None, ys[0][1], 1.0, "a", f), ("Q", "USD", None, ys[0][1], 2.0, "a", f), ("Q", "USD", None, ys[1][1], 3.0, "a", f)]
    m = (metrics.Metric("revenue", "Revenue", "flow", "USD", ("New", "Old")), metrics.Metric("equity", "Equity", "stock", "USD", ("P", "Q"), resolve_by="priority"), metrics.Metric("none", "None", "flow", "USD", ("X",)))
    cur = facts.current(table(spark, rows))
    res = metrics.resolve_tags(metrics.candidates(cur, metrics.tag_table(spark, m)))
    assert sorted((r.metric, r.tag) for r in metrics.primary_tags(res).collect()) == [("equity", "P"), ("revenue", "Old")]
    reg = metrics.registry_table(spark, m)
    mf = metrics.metric_facts(cur, res, reg)
    assert {(r.period_end.year, r.val) for r in mf.filter("metric = 'revenue'").collect()} == {(2015 + i, 1.0 + i) for i in range(5)}
    assert {(r.period_end.year, r.tag) for r in mf.filter("metric = 'equity'").collect()} == {(2015, "P"), (2016, "Q")}
    wide = metrics.wide(mf, m).orderBy("period_end").collect()
    assert [(r.revenue, r.equity, r.none) for r in wide][:3] == [(1.0, 1.0, None), (2.0, 3.0, None), (3.0, None, None)]
    cov = {r.metric: r.companies for r in metrics.coverage(reg, metrics.primary_tags(res)).collect()}
    assert cov == {"revenue": 1, "equity": 1, "none": 0}
    co = spark.createDataFrame([("1", "T"), ("2", "U")], "cik string, ticker string")
    assert {r.metric: r.tickers for r in metrics.gaps(reg, co, metrics.primary_tags(res)).collect()} == {"none": "T, U", "revenue": "U", "equity": "U"}
    assert [r.ticker for r in metrics.without_metric(co, mf, "revenue").collect()] == ["U"]


COLS = "cik string, ticker string, period_end date, period_start date, revenue double, cost_of_revenue double, gross_profit double, operating_income double, net_income double, equity double, equity_incl_nci double, minority_interest double, temporary_equity double, assets double, liabilities double, operating_cash_flow double, capex double"


def test_ratios_and_growth(spark):
    rows = [("1", "T", D("2020-12-31"), D("2020-01-01"), 100.0, 60.0, None, 20.0, None, 50.0, None, 5.0, 1.0, 200.0, None, 30.0, 10.0),
            ("1", "T", D("2021-12-31"), D("2021-01-01"), 110.0, 60.0, 55.0, 20.0, 11.0, 0.0, 60.0, None, None, 200.0, 7.0, 30.0, None),
            ("1", "T", D("2022-12-31"), D("2022-01-01"), 121.0, None, None, None, 22.0, None, None, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, COLS)
    a, b, c = metrics.ratios(raw).orderBy("period_end").collect()
    assert (a.gross_profit, a.gross_profit_tagged, a.liabilities, a.free_cash_flow) == (40.0, None, 144.0, 20.0)
    assert (b.gross_profit, b.liabilities, b.return_on_equity, b.debt_to_equity, b.free_cash_flow) == (55.0, 7.0, None, None, None)
    assert b.revenue_yoy == pytest.approx(0.1) and a.revenue_yoy is None and b.net_income_yoy is None and c.net_income_yoy == pytest.approx(1.0)
    (g,) = metrics.growth(raw).collect()
    years = 730 / 365.25
    assert g.revenue_cagr == pytest.approx(1.21 ** (1 / years) - 1) and g.net_income_cagr == pytest.approx(2 ** (1 / years) - 1) and g.years == 3


def test_registry_of_filings():
    names = [m.name for m in metrics.FILINGS]
    assert len(names) == len(set(names)) == 27
    assert [m.name for m in metrics.FILINGS if m.resolve_by == "priority"] == ["equity"]
    assert len({(m.name, t) for m in metrics.FILINGS for t in m.tags}) == sum(len(m.tags) for m in metrics.FILINGS)


def test_balance(spark):
    e, f = D("2023-12-31"), D("2024-01-01")
    rows = [(t, "USD", None, e, v, a, f) for a, vs in {"ok": (100.0, 60.0, 39.8), "bad": (100.0, 60.0, 30.0), "part": (100.0, None, 1.0)}.items() for t, v in zip("ALE", vs, strict=True) if v is not None]
    assert [r.accn for r in facts.balance_violations(table(spark, rows), "A", ["L", "E"]).collect()] == ["bad"]


def test_concepts(spark):
    con = spark.createDataFrame([("us-gaap", "Assets", "Assets"), ("us-gaap", "AssetsCurrent", "Assets, Current"), ("us-gaap", "CostOfRevenue", "Cost of Revenue"), ("us-gaap", "NetIncomeLoss", "Net Income (Loss) Attributable to Parent"), ("us-gaap", "Revenues", None), ("x", "Other", "Other")], "taxonomy string, tag string, label string")
    q = spark.createDataFrame(enumerate(["assets, current", "net income loss", "Total current assets", "net income", "total revenue", "zebra", "", "the of"]), "qid long, phrase string")
    got = {r.qid: (r.tag, r.how, r.score) for r in lookup.resolve_concepts(q, con, metrics.FILINGS).collect()}
    assert got[0] == ("AssetsCurrent", "exact-label", 1.0)
    assert got[1] == ("NetIncomeLoss", "exact-tag", 1.0)
    assert got[2] == ("AssetsCurrent", "metric-label", 1.0)
    assert got[3][:2] == ("NetIncomeLoss", "metric-label") or got[3] == ("NetIncomeLoss", "overlap", 0.96)
    assert got[4] == ("CostOfRevenue", "overlap", 0.49)  # one word of two, and one too many beside it
    assert not {5, 6, 7} & set(got)


def test_lookup(spark):
    f = D("2024-02-01")
    rows = [("A", "USD", D("2022-01-01"), D("2022-12-31"), 1.0, "k1", f), ("A", "USD", D("2023-01-01"), D("2023-12-30"), 2.0, "k2", f), ("A", "USD", D("2024-01-01"), D("2024-12-28"), 3.0, "gone", f)]
    cur = table(spark, rows)
    fil = spark.createDataFrame([("k1", "10-K"), ("k2", "10-K/A")], "accn string, form string")
    con = spark.createDataFrame([("us-gaap", "A", "A label")], "taxonomy string, tag string, label string")
    q = spark.createDataFrame([(1, "t", "us-gaap", "A", "USD", D("2024-01-03")), (2, "T", "us-gaap", "A", "USD", None), (3, "T", "us-gaap", "A", "USD", D("2024-01-20")), (4, "T", "us-gaap", "B", "USD", None)], "qid long, ticker string, taxonomy string, tag string, unit string, target date")
    got = {r.qid: (r.val, r.form, r.label) for r in lookup.lookup(q, cur, fil, con).collect()}
    assert got == {1: (2.0, "10-K/A", "A label"), 2: (2.0, "10-K/A", "A label")}
    c = q.withColumn("accn", F.when(F.col("qid") == 1, "k2").otherwise(""))
    assert {r.qid: r.val for r in lookup.recheck(c, cur).collect()} == {1: 2.0, 2: 3.0}


def test_payload(spark):
    e = lambda **k: {"end": "2023-12-31", "filed": "2024-01-01", "accn": "a", "form": "10-K", "fy": 2023, "fp": "FY", **k}
    p = {"facts": {"us-gaap": {"Rev": {"label": "L", "description": None, "units": {"USD": [e(start="2023-01-01", val=5), e(val="text"), e(val=None), e(end="bad", val=1), e(accn=None, val=1, filed=None), e(val=2.5)]}}}, "dei": {"N": {"label": "x", "description": "d", "units": {}}}}}
    df = spark.createDataFrame([("1", "B", json.dumps(p)), ("2", "A", json.dumps({"facts": {"us-gaap": {"Rev": {"label": "first", "description": "d", "units": {}}}}})), ("3", "C", "{")], "cik string, ticker string, payload string")
    got = sorted((r.span, r.period_type, r.period_days, r.val) for r in xbrl.facts(df).collect())
    assert got == [("FY", "duration", 365, 5.0), ("instant", "instant", None, 2.5)]
    assert {r.skip: r.n for r in xbrl.skipped(df).collect()} == {"value": 2, "date": 2}
    assert {(r.taxonomy, r.tag): r.label for r in xbrl.concepts(df).collect()} == {("us-gaap", "Rev"): "first", ("dei", "N"): "x"}
    assert df.select(xbrl.concept_count(F.col("payload"))).first()[0] == 2


def test_manifest(spark):
    s = "accn string, cik string, form string, bytes long, path string"
    old = spark.createDataFrame([("a", "1", "10-K", 1, "p"), ("b", None, "10-Q", 2, "q")], s)
    new = spark.createDataFrame([("a", "9", "8-K", 7, "pp"), ("c", "2", "10-K", 3, "r")], s)
    got = {r.accn: tuple(r)[1:] for r in manifest.upsert(old, new, "accn", ["bytes", "path"]).collect()}
    assert got == {"a": ("1", "10-K", 7, "pp"), "b": (None, "10-Q", 2, "q"), "c": ("2", "10-K", 3, "r")}
    assert {r.cik for r in manifest.upsert(old, new, "accn").collect()} == {"9", None, "2"}
    keep = spark.createDataFrame([("2",)], "cik string")
    assert sorted(r.accn for r in manifest.prune(old, keep).collect()) == ["b"]
    assert manifest.prune(old, keep.limit(0)).count() == 2
    assert [r.accn for r in manifest.missing_files(old, spark.createDataFrame([("p",)], "path string")).collect()] == ["b"]
    assert [r.accn for r in manifest.fresh(new, old, "accn").collect()] == ["c"]
    assert [r.accn for r in manifest.largest(old, 1).collect()] == ["b"]


def test_universe_and_index(spark, tmp_path):
    spec = {"companies": [{"ticker": "aapl", "name": "A"}, {"ticker": "XOM", "cik": 34088}], "forms": ["10-K"], "window": {"from": "2020-01-01", "to": "2021-12-31"}}
    co, forms, window = filings.universe(spark, spec)
    tm = filings.ticker_map(spark.createDataFrame([(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"}, "1": {"cik_str": 1, "ticker": "XOM", "title": "x"}}),)], "payload string"))
    got = filings.resolve_ciks(co, tm)
    assert {r.ticker: r.cik for r in got.collect()} == {"AAPL": "0000320193", "XOM": "0000034088"}
    assert filings.unresolved(filings.resolve_ciks(co, tm.limit(0))) == ["AAPL"]
    with pytest.raises(ValueError):
        filings.universe(spark, {**spec, "companies": spec["companies"] * 2})
    with pytest.raises(ValueError):
        filings.universe(spark, {**spec, "forms": []})
    block = lambda n, y: {"accessionNumber": [f"{n}{i}" for i in range(2)], "form": ["10-K", "4"], "filingDate": [f"{y}-02-01"] * 2, "reportDate": [f"{y - 1}-12-31"] * 2, "primaryDocument": ["d.htm", ""], "size": [1, 2]}
    (tmp_path / "main.json").write_text(json.dumps({"filings": {"recent": block("r", 2022), "files": [{"name": "c1.json", "filingTo": "2021-12-31"}, {"name": "gone.json", "filingTo": "2010-12-31"}]}}))
    (tmp_path / "c1.json").write_text(json.dumps(block("c", 2021)))
    spark.dataSource.register(filings.SubmissionsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    src = spark.read.format("filing_index").options(main=str(tmp_path / "main.json"), folder=str(tmp_path)).load()
    rows = src.filter("filed >= '2021-01-01'")  # the chunk that ends in 2010 isn't there, and isn't opened
    assert [r.accn for r in filings.select_filings(rows, forms, *window).collect()] == ["r0", "c0"]
    z = spark.createDataFrame([(["a"], ["10-K", "x"], ["f"], ["p"], ["d"], [1])], "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>, size array<long>")
    with pytest.raises(Exception, match="differ in length"):
        filings.zip_index(z).collect()
