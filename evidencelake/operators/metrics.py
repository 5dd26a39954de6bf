"""Metrics over facts: tag resolution, the wide pivot, ratios and growth.

A registry is a list of ``Metric``; it gives the broadcast dimension of the joins
and the value list of the pivot, so no query loops over metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    kind: str  # flow, stock, per_share or count
    unit: str
    tags: tuple[str, ...]
    derive: str = ""
    universal: bool = True
    sign: str = "as_filed"
    resolve_by: str = "coverage"

    @property
    def period_type(self) -> str:
        return "instant" if self.kind == "stock" else "duration"


def _m(name, label, kind, unit, *tags, derive="", universal=True, sign="as_filed", resolve_by="coverage") -> Metric:
    return Metric(name, label, kind, unit, tags, derive, universal, sign, resolve_by)


# Metrics, their units and the public taxonomy's tags in order of priority.
FILINGS = (
    _m("revenue", "Revenue", "flow", "USD", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues",
       "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"),
    _m("cost_of_revenue", "Cost of revenue", "flow", "USD", "CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices", universal=False),
    _m("gross_profit", "Gross profit", "flow", "USD", "GrossProfit", derive="revenue - cost_of_revenue"),
    _m("operating_income", "Operating income", "flow", "USD", "OperatingIncomeLoss", universal=False),
    _m("pretax_income", "Pretax income", "flow", "USD",
       "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
       "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"),
    _m("net_income", "Net income", "flow", "USD", "NetIncomeLoss", "ProfitLoss"),
    _m("income_tax", "Income tax expense", "flow", "USD", "IncomeTaxExpenseBenefit"),
    _m("rnd", "Research and development", "flow", "USD", "ResearchAndDevelopmentExpense",
       "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost", universal=False),
    _m("sga", "Selling, general and administrative", "flow", "USD", "SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"),
    _m("interest_expense", "Interest expense", "flow", "USD", "InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt", universal=False),
    _m("operating_cash_flow", "Cash from operations", "flow", "USD", "NetCashProvidedByUsedInOperatingActivities",
       "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    _m("capex", "Capital expenditure", "flow", "USD", "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets", universal=False, sign="outflow"),
    _m("free_cash_flow", "Free cash flow", "flow", "USD", derive="operating_cash_flow - capex", universal=False),
    _m("dividends_paid", "Dividends paid", "flow", "USD", "PaymentsOfDividendsCommonStock", "PaymentsOfDividends", universal=False, sign="outflow"),
    _m("assets", "Total assets", "stock", "USD", "Assets"),
    _m("assets_current", "Total current assets", "stock", "USD", "AssetsCurrent"),
    _m("liabilities", "Total liabilities", "stock", "USD", "Liabilities",
       derive="assets - coalesce(equity_incl_nci, equity + coalesce(minority_interest, 0)) - coalesce(temporary_equity, 0)"),
    _m("liabilities_current", "Total current liabilities", "stock", "USD", "LiabilitiesCurrent"),
    _m("equity", "Shareholders' equity", "stock", "USD", "StockholdersEquity",
       "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", resolve_by="priority"),
    _m("equity_incl_nci", "Total equity including noncontrolling interests", "stock", "USD",
       "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", universal=False),
    _m("minority_interest", "Noncontrolling interests", "stock", "USD", "MinorityInterest", universal=False),
    _m("temporary_equity", "Temporary (mezzanine) equity", "stock", "USD",
       "TemporaryEquityCarryingAmountIncludingPortionAttributableToNoncontrollingInterests",
       "TemporaryEquityCarryingAmountAttributableToParent", "TemporaryEquityValueExcludingAdditionalPaidInCapital",
       "RedeemableNoncontrollingInterestEquityCarryingAmount", universal=False),
    _m("cash", "Cash and equivalents", "stock", "USD", "CashAndCashEquivalentsAtCarryingValue",
       "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
    _m("inventory", "Inventory", "stock", "USD", "InventoryNet", universal=False),
    _m("long_term_debt", "Long-term debt", "stock", "USD", "LongTermDebtNoncurrent", "LongTermDebt"),
    _m("eps_diluted", "Diluted EPS", "per_share", "USD/shares", "EarningsPerShareDiluted"),
    _m("shares_diluted", "Diluted shares outstanding", "count", "shares", "WeightedAverageNumberOfDilutedSharesOutstanding"),
)


def registry_table(spark: SparkSession, metrics) -> DataFrame:
    """One row a metric."""
    rows = [(m.name, m.label, m.kind, m.unit, ", ".join(m.tags), m.derive or None, m.universal, m.sign, m.resolve_by) for m in metrics]
    return spark.createDataFrame(rows, "metric string, label string, kind string, unit string, tags string, derive string, universal boolean, sign string, resolve_by string")


def tag_table(spark: SparkSession, metrics) -> DataFrame:
    """One row a metric and tag: the dimension that facts are joined with."""
    rows = [(m.name, m.label, m.kind, m.unit, m.period_type, m.resolve_by, t, i) for m in metrics for i, t in enumerate(m.tags)]
    return spark.createDataFrame(rows, "metric string, label string, kind string, unit string, period_type string, resolve_by string, tag string, priority int")


def candidates(current: DataFrame, tags: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """How often and when each company reports each metric's tags: one join and one aggregation."""
    f = current.filter((F.col("taxonomy") == taxonomy) & (F.col("span") != "other"))
    j = f.join(F.broadcast(tags), ["tag", "unit", "period_type"])
    return j.groupBy("cik", "ticker", "metric", "tag", "priority", "resolve_by").agg(
        F.count(F.lit(1)).alias("n_facts"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"))


def resolve_tags(found: DataFrame) -> DataFrame:
    """Candidates ranked per company and metric: by coverage, or by the registry's priority where it says so."""
    first = F.when(F.col("resolve_by") == "priority", F.col("priority"))
    w = Window.partitionBy("cik", "metric").orderBy(first.asc_nulls_last(), F.col("n_facts").desc(), "priority", "tag")
    return found.withColumn("resolution_rank", F.row_number().over(w)).drop("resolve_by")


def primary_tags(resolved: DataFrame) -> DataFrame:
    return resolved.filter("resolution_rank = 1").select("cik", "ticker", "metric", "tag", "n_facts", "first_period", "last_period")


def metric_facts(current: DataFrame, resolved: DataFrame, registry: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """Facts under their metric's name, the best-ranked tag for each period. A tag of two metrics gives two rows."""
    f = current.filter((F.col("taxonomy") == taxonomy) & (F.col("span") != "other"))
    r = F.broadcast(registry.select("metric", "label", F.col("unit").alias("_unit")))
    j = f.join(resolved.select("cik", "tag", "metric", "resolution_rank"), ["cik", "tag"]).join(r, "metric").filter("unit = _unit").drop("_unit")
    w = Window.partitionBy("cik", "metric", "span", "period_start", "period_end").orderBy("resolution_rank")
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def fiscal_years(mfacts: DataFrame) -> DataFrame:
    """Dates on which a company reports a full year."""
    return mfacts.filter("span = 'FY'").select("cik", "ticker", F.col("period_end").alias("fiscal_end"), F.col("period_start").alias("fiscal_start")).distinct()


def wide(mfacts: DataFrame, metrics, span: str = "FY") -> DataFrame:
    """A row for each company's year, a column for each metric: flows of the span, stocks at its end."""
    y = fiscal_years(mfacts).select("cik", F.col("fiscal_end").alias("period_end"), "fiscal_start")
    cell = lambda m: F.max(F.when((F.col("metric") == m.name) & (F.col("span") == ("instant" if m.kind == "stock" else span)), F.col("val"))).alias(m.name)
    j = mfacts.drop("period_start").join(y, ["cik", "period_end"])
    return j.groupBy("cik", "ticker", "period_end", F.col("fiscal_start").alias("period_start")).agg(*[cell(m) for m in metrics if m.tags])


def _ratio(a, b):
    return a / F.nullif(b, F.lit(0.0))


def ratios(raw: DataFrame) -> DataFrame:
    """Reported values where there are any, identities where not; margins, returns and growth on the year before."""
    c = F.col
    gross = F.coalesce("gross_profit", c("revenue") - c("cost_of_revenue"))
    whole = F.coalesce(c("equity_incl_nci"), c("equity") + F.coalesce(c("minority_interest"), F.lit(0.0)))
    owed = F.coalesce("liabilities", c("assets") - whole - F.coalesce(c("temporary_equity"), F.lit(0.0)))
    w = Window.partitionBy("cik").orderBy("period_end", "period_start")
    grow = lambda x: _ratio(c(x), F.lag(x).over(w)) - 1
    return raw.select(
        *[x for x in raw.columns if x not in ("gross_profit", "liabilities")],
        c("gross_profit").alias("gross_profit_tagged"), c("liabilities").alias("liabilities_tagged"),
        gross.alias("gross_profit"), owed.alias("liabilities"), (c("operating_cash_flow") - c("capex")).alias("free_cash_flow"),
        _ratio(gross, c("revenue")).alias("gross_margin"), _ratio(c("operating_income"), c("revenue")).alias("operating_margin"),
        _ratio(c("net_income"), c("revenue")).alias("net_margin"), _ratio(c("net_income"), c("equity")).alias("return_on_equity"),
        _ratio(c("net_income"), c("assets")).alias("return_on_assets"), _ratio(owed, c("equity")).alias("debt_to_equity"),
        grow("revenue").alias("revenue_yoy"), grow("net_income").alias("net_income_yoy"), F.lag("period_end").over(w).alias("prior_period_end"),
    )


def growth(raw: DataFrame, first: str = "revenue", second: str = "net_income") -> DataFrame:
    """Compound yearly growth over the years a company holds, counted from the dates; rows without ``first`` don't count."""
    rows = raw.filter(F.col(first).isNotNull())
    years = F.date_diff(F.max("period_end"), F.min("period_end")) / F.lit(365.25)
    key = F.struct("period_end", "period_start") if "period_start" in raw.columns else F.col("period_end")
    # an end without a value is passed over
    low = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), key))
    high = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), key))
    g = rows.groupBy("cik", "ticker").agg(
        F.min("period_end").alias("from_period"), F.max("period_end").alias("to_period"), F.count(F.lit(1)).alias("years"), years.alias("span_years"),
        low(first).alias(f"{first}_first"), high(first).alias(f"{first}_last"), low(second).alias("_a"), high(second).alias("_b"),
    )
    rate = lambda a, b: F.pow(_ratio(b, a), F.lit(1.0) / F.nullif(F.col("span_years"), F.lit(0.0))) - 1
    return g.select("*", rate(F.col(f"{first}_first"), F.col(f"{first}_last")).alias(f"{first}_cagr"), rate(F.col("_a"), F.col("_b")).alias(f"{second}_cagr")).drop("_a", "_b")


def coverage(registry: DataFrame, primary: DataFrame) -> DataFrame:
    """Companies that report each metric with tags."""
    n = primary.groupBy("metric").agg(F.count("cik").alias("companies"))
    r = registry.filter("tags <> ''").select("metric", "universal", F.col("derive").isNotNull().alias("derivable"))
    return r.join(n, "metric", "left").select("metric", F.coalesce("companies", F.lit(0)).alias("companies"), "universal", "derivable")


def gaps(registry: DataFrame, companies: DataFrame, primary: DataFrame) -> DataFrame:
    """For each metric with tags, the companies that don't report it. The registry is the small, bounded side of the product."""
    every = companies.select("cik", "ticker").crossJoin(F.broadcast(registry.filter("tags <> ''").select("metric")))
    missing = every.join(primary.select("cik", "metric"), ["cik", "metric"], "left_anti")
    return missing.groupBy("metric").agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.sort_array(F.collect_list("ticker")), ", ").alias("tickers"))


def without_metric(companies: DataFrame, mfacts: DataFrame, metric: str) -> DataFrame:
    """Companies with no fact of a metric."""
    return companies.join(mfacts.filter(F.col("metric") == metric).select("cik"), "cik", "left_anti")
