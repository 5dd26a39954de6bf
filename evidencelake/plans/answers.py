"""Queries over answers, evaluations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import answer, evals, verify
from evidencelake.plans import texts
from evidencelake.streaming import limits, traces
from evidencelake.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# -- questions and the answering loop ------------------------------------


def _questions(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    n = F.col("c_custkey").cast("string")
    return c.select(
        F.col("c_custkey").alias("qid"),
        F.concat(F.lit("What did C"), (F.col("c_custkey") % 7).cast("string"), F.lit(" and AB report for 199"), (F.col("c_custkey") % 10).cast("string"), F.lit("-03-31 in segment "), F.col("c_mktsegment"), F.lit(" no. "), n, F.lit("?")).alias("question"),
        (F.col("c_custkey") % 4).cast("int").alias("kind"),
    )


_Q = "q AS (SELECT c_custkey AS qid, 'What did C' || CAST(c_custkey % 7 AS VARCHAR) || ' and AB report for 199' || CAST(c_custkey % 10 AS VARCHAR) || '-03-31 in segment ' || c_mktsegment || ' no. ' || CAST(c_custkey AS VARCHAR) || '?' AS question, c_custkey % 4 AS kind FROM customer)"


@query(f"WITH {_Q} SELECT qid, question, question AS text, 'text' AS route, 'AB' AS ticker, '' AS concept, regexp_extract(question, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS period_end FROM q")
def heuristic_plan(spark, d):
    return answer.heuristic_plan(_questions(spark, d))


def _plans(spark, d) -> DataFrame:
    q = _questions(spark, d)
    route = F.element_at(F.array(F.lit("sql"), F.lit("text"), F.lit("graph"), F.lit("refuse")), F.col("kind") + 1)
    return q.select(
        "qid", "question", F.col("question").alias("text"), route.alias("route"), F.when(F.col("qid") % 5 == 0, "ZZ").otherwise("AB").alias("ticker"),
        F.when(F.col("qid") % 3 > 0, "net income").otherwise("").alias("concept"), F.when(F.col("qid") % 2 == 0, "1995-03-31").otherwise("").alias("period_end"),
    )


def _retrieve(states: DataFrame) -> DataFrame:
    """Stand-ins of the stores: sql finds facts only without a period, text finds one company's passages, graph nothing."""
    sql = states.filter("route = 'sql' AND period_end = '' AND qid % 8 <> 4").select(
        "qid", F.lit("fact").alias("kind"), F.lit("net income").alias("body"), F.lit(1.0).alias("score"), (F.col("qid") * 1000).cast("double").alias("value"), F.lit("USD").alias("unit"), F.lit("NetIncomeLoss").alias("tag"), F.lit("1995-12-31").alias("period_end"), F.col("ticker"))
    text = states.filter("route = 'text' AND qid % 10 <> 1").select(
        "qid", F.lit("text").alias("kind"), F.col("text").alias("body"), F.when(F.col("text").startswith("ZZ"), 0.5).otherwise(F.lit(0.25)).alias("score"), F.lit(None).cast("double").alias("value"), F.lit("").alias("unit"), F.lit("").alias("tag"), F.lit("").alias("period_end"),
        F.when(F.col("text").startswith("ZZ"), "ZZ").otherwise("AB").alias("ticker"))
    return sql.unionByName(text).withColumn("idx", F.lit(1))


_FINAL = """p AS (SELECT qid, ['sql', 'text', 'graph', 'refuse'][kind + 1] AS route, CASE WHEN qid % 5 = 0 THEN 'ZZ' ELSE 'AB' END AS ticker, qid % 3 > 0 AS con, qid % 2 = 0 AS per FROM q),
r0 AS (SELECT *, CASE WHEN route = 'graph' OR (route = 'sql' AND NOT con) THEN 'text' ELSE route END AS r FROM p),
s0 AS (SELECT *, CASE WHEN r = 'refuse' THEN true WHEN r = 'sql' THEN NOT per AND qid % 8 <> 4 ELSE qid % 10 <> 1 AND ticker = 'AB' END AS ok0 FROM r0),
r1 AS (SELECT *, CASE WHEN r = 'sql' AND NOT ok0 AND NOT per THEN 'text' ELSE r END AS r1, r = 'sql' AND NOT ok0 AND per AS dropped, r = 'text' AND NOT ok0 AND qid % 10 <> 1 AS fixed FROM s0),
s1 AS (SELECT *, CASE WHEN ok0 THEN true WHEN r1 = 'sql' THEN qid % 8 <> 4 WHEN qid % 10 = 1 THEN false ELSE fixed OR ticker = 'AB' END AS ok1 FROM r1),
r2 AS (SELECT *, CASE WHEN NOT ok1 AND r1 = 'sql' THEN 'text' ELSE r1 END AS r2, NOT ok1 AND r1 = 'text' AND qid % 10 <> 1 AND ticker = 'ZZ' AS fixed2 FROM s1),
s2 AS (SELECT *, CASE WHEN ok1 THEN true WHEN qid % 10 = 1 THEN false WHEN r1 = 'sql' THEN ticker = 'AB' ELSE fixed2 OR ticker = 'AB' END AS ok2 FROM r2)"""


@query(f"WITH {_Q}, {_FINAL} SELECT qid, r2 AS route, CASE WHEN ok0 THEN 0 WHEN ok1 THEN 1 ELSE 2 END AS repairs, ok2 AS ok FROM s2")
def repair_unrolled(spark, d):
    """The whole loop: routes with replacements, grades, and up to two repairs of what failed."""
    done, _ = answer.run(_plans(spark, d), _retrieve, graph=False)
    return done.select("qid", "route", "repairs", "ok")


@query()
def synthesised_answers(spark, d):
    done, shown = answer.run(_plans(spark, d), _retrieve, graph=False)
    return answer.synthesise(done, shown).select("qid", "route", "repairs", "answer", "refused")


# -- verification --------------------------------------------------------


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each order's price in an answer of one of six kinds, with its line and its document as evidence."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 6).alias("kind"))
    v = F.greatest(F.floor(F.col("o_totalprice") / 1000) * 1000, F.lit(2000).cast("long"))
    price = F.format_number(v, 0)
    texts_ = [
        F.concat(F.lit("The order came to $"), price, F.lit(" [1].")), F.concat(F.lit("It reported "), F.format_number(F.floor(v / 1000), 0), F.lit(" thousand [1].")),
        F.concat(F.lit("The total was "), F.format_number(v + 777777, 0), F.lit(" [1].")), F.concat(F.lit("The total was "), price, F.lit(". No source is named.")),
        F.concat(F.lit("In 1997 the total was "), price, F.lit(" [1] [7].")), F.lit("Business was good [2]."),
    ]
    a = o.select("o_orderkey", "kind", F.element_at(F.array(*texts_), F.col("kind").cast("int") + 1).alias("answer"))
    a = a.select(
        F.col("o_orderkey").alias("qid"), "answer", F.lit("What was the total of 1997?").alias("question"), F.lit("sql").alias("route"), F.lit(False).alias("refused"),
        F.lit(True).alias("grade_ok"), F.lit(0).alias("repairs"), F.array().cast("array<string>").alias("repair_log"),
    )
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    fact = o.select(
        F.col("o_orderkey").alias("qid"), F.lit(1).alias("idx"), F.lit("fact").alias("kind"), F.lit("the total for the period ending 1997-12-31").alias("body"), F.lit("c").alias("citation"), key.alias("accn"),
        v.cast("double").alias("value"), F.lit("USD").alias("unit"), F.lit("Total").alias("tag"), F.lit("1997-12-31").alias("period_end"), F.lit("C1").alias("ticker"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"),
    )
    prose = fact.withColumn("idx", F.lit(2)).withColumn("kind", F.lit("text")).withColumn("body", F.lit("a passage without a place")).withColumn("value", F.lit(None).cast("double")).withColumn("tag", F.lit(""))
    return a, fact.unionByName(prose)


_KIND = "k AS (SELECT o_orderkey AS qid, o_orderkey % 6 AS kind, greatest(floor(o_totalprice / 1000) * 1000, 2000) AS v FROM orders)"


@query(f"WITH {_KIND} SELECT qid, CASE kind WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS n_figures, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS n_unsupported, CASE WHEN kind IN (0, 1, 3, 4) THEN 1 ELSE 0 END AS n_supported, CASE WHEN kind = 4 THEN 1 ELSE 0 END AS n_context FROM k")
def number_verify(spark, d):
    a, e = _answers(spark, d)
    n = verify.check_numbers(a, e).groupBy("qid")
    of = lambda s: F.sum((F.col("status") == s).cast("int")).cast("int")
    got = n.agg(F.count(F.lit(1)).cast("int").alias("n_figures"), of("unsupported").alias("n_unsupported"), of("supported").alias("n_supported"), of("context").alias("n_context"))
    return a.select("qid").join(got, "qid", "left").na.fill(0)


@query(f"WITH {_KIND} SELECT qid, CASE WHEN kind IN (0, 1, 2, 4) THEN [1] ELSE [] END AS made, CASE WHEN kind = 4 THEN [7] ELSE [] END AS dangling, CASE WHEN kind = 5 THEN [2] ELSE [] END AS unlocatable FROM k")
def citation_resolve(spark, d):
    return verify.citations(*_answers(spark, d))


@query(f"WITH {_KIND} SELECT qid, CASE WHEN kind = 3 THEN 1 ELSE 0 END AS n_uncited FROM k")
def uncited_claims(spark, d):
    return verify.uncited(_answers(spark, d)[0]).select("qid", F.size("uncited").alias("n_uncited"))


@query(f"WITH {_KIND} SELECT qid, kind IN (0, 1) AS ok, kind NOT IN (0, 1) AS blocked, CASE WHEN kind = 2 THEN 'synthesis_drift,grader_false_positive' WHEN kind = 4 THEN 'grader_false_positive' ELSE '' END AS taxonomy FROM k")
def guard(spark, d):
    a, e = _answers(spark, d)
    g = verify.guard(verify.verdicts(a, e), refusal=answer.REFUSAL)
    return g.select("qid", "ok", "blocked", F.array_join("taxonomy", ",").alias("taxonomy"))


@query(f"""WITH {_KIND} SELECT count(*) AS answers, count(*) FILTER (WHERE kind < 2) AS verified, count(*) FILTER (WHERE kind >= 2) AS blocked, count(*) FILTER (WHERE kind < 5) AS figures,
  count(*) FILTER (WHERE kind IN (0, 1, 3, 4)) AS supported, CAST(0 AS BIGINT) AS derived, count(*) FILTER (WHERE kind = 2) AS unsupported, count(*) FILTER (WHERE kind IN (0, 1, 2, 4)) AS citations, count(*) FILTER (WHERE kind = 4) AS dangling,
  count(*) FILTER (WHERE kind = 5) AS unlocatable, count(*) FILTER (WHERE kind = 3) AS uncited, count(*) FILTER (WHERE kind = 2) / count(*) FILTER (WHERE kind < 5) AS hallucination_rate,
  count(*) FILTER (WHERE kind IN (0, 1, 2, 4)) / (count(*) FILTER (WHERE kind IN (0, 1, 2, 4, 5)) + count(*) FILTER (WHERE kind = 4)) AS locator_rate FROM k""")  # fmt: skip
def guard_report(spark, d):
    a, e = _answers(spark, d)
    return verify.guard_report(verify.guard(verify.verdicts(a, e))).drop("by_digits")


@query(f"""WITH {_KIND}, g AS (SELECT * FROM k WHERE kind < 2) SELECT m AS mutation, count(*) AS n, count(*) AS caught FROM g CROSS JOIN (SELECT unnest(['figure_changed', 'dangling', 'uncited', 'figure_added']) AS m)
WHERE m <> 'figure_changed' OR kind = 0 OR v >= 10000 GROUP BY m""")
def negative_control(spark, d):
    """Mutated versions of the answers that pass, and how many of each the verifier stops; all are checked in one pass."""
    a, e = _answers(spark, d)
    every = verify.mutations(a).unionByName(a.withColumn("mutation", F.lit("none")))
    named = every.withColumn("base", F.col("qid")).withColumn("qid", F.concat_ws(":", "mutation", F.col("base").cast("string")))
    v = verify.verdicts(named, e, key="base").select(F.split("qid", ":").alias("k"), "ok").select(F.get("k", F.lit(0)).alias("mutation"), F.get("k", F.lit(1)).alias("base"), "ok")
    good = v.filter("mutation = 'none' and ok").select("base")
    return v.filter("mutation <> 'none'").join(good, "base").groupBy("mutation").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("ok")).cast("long")).alias("caught"))


@query()
def document_figures(spark, d):
    """Figures stated in documents."""
    a = texts._docs(spark, d).select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("answer"))
    return verify.claims(a).select("qid", "pos", "text", "face")


# -- scores --------------------------------------------------------------


def _outcomes(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("qid"), F.when(k % 4 == 0, "unanswerable").when(k % 4 == 1, "narrative").otherwise("numeric").alias("slice"), F.when(k % 4 == 1, "text").when(k % 4 > 1, "sql").alias("expected_route"),
        F.when(k % 7 == 0, "refuse").when(k % 4 == 1, "text").otherwise("sql").alias("route"), (k % 14 == 0).alias("has_spans"), (k % 7 == 0).alias("refused"), (k % 4 > 1).alias("exact"),
        F.when(k % 101 == 0, "timeout").otherwise("").alias("error"), (k % 3).cast("long").alias("llm_calls"), (k % 16 / 4).alias("seconds"), (k % 11 == 0).alias("blocked"),
    )


_OUT = """oc AS (SELECT o_orderkey AS k, o_orderkey AS qid, CASE WHEN o_orderkey % 4 = 0 THEN 'unanswerable' WHEN o_orderkey % 4 = 1 THEN 'narrative' ELSE 'numeric' END AS slice, CASE WHEN o_orderkey % 4 = 1 THEN 'text' WHEN o_orderkey % 4 > 1 THEN 'sql' END AS expected,
  CASE WHEN o_orderkey % 7 = 0 THEN 'refuse' WHEN o_orderkey % 4 = 1 THEN 'text' ELSE 'sql' END AS route, o_orderkey % 14 = 0 AS spans, o_orderkey % 7 = 0 AS refused, CASE WHEN o_orderkey % 101 = 0 THEN 'timeout' ELSE '' END AS error,
  o_orderkey % 3 AS llm_calls, (o_orderkey % 16) / 4 AS seconds, o_orderkey % 11 = 0 AS blocked FROM orders),
og AS (SELECT *, CASE WHEN route <> 'refuse' THEN route WHEN spans THEN 'text' END AS got, slice <> 'unanswerable' AS ans FROM oc)"""
_CARD = """count(*) AS n, avg(CASE WHEN slice = 'numeric' THEN CASE WHEN NOT refused THEN 1.0 ELSE 0.0 END END) AS exact_match, avg(CASE WHEN ans THEN CASE WHEN got = expected THEN 1.0 ELSE 0.0 END END) AS router_accuracy, count(*) FILTER (WHERE ans) AS router_n,
  count(*) FILTER (WHERE ans AND route = 'refuse' AND got IS NOT NULL) AS router_recovered, count(*) FILTER (WHERE ans AND route = 'refuse' AND got IS NULL) AS router_unrecoverable,
  avg(CASE WHEN NOT ans THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END END) AS abstention, 1 - avg(CASE WHEN NOT ans THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END END) AS over_answered, count(*) FILTER (WHERE error <> '') AS errors,
  CAST(sum(llm_calls) AS BIGINT) AS llm_calls, sum(seconds) AS seconds"""


@query(f"WITH {_OUT} SELECT slice, {_CARD} FROM og GROUP BY slice UNION ALL SELECT 'overall', {_CARD} FROM og")
def scorecard(spark, d):
    return evals.scorecard(_outcomes(spark, d))


@query(f"WITH {_OUT} SELECT qid, CASE WHEN error <> '' THEN 'error' WHEN blocked THEN 'blocked' WHEN refused THEN 'abstained' ELSE 'answered' END AS state FROM oc")
def outcome_state(spark, d):
    return answer.outcome_state(_outcomes(spark, d)).select("qid", "state")


@query(f"""WITH {_OUT}, c AS (SELECT slice, {_CARD} FROM og GROUP BY slice), l AS (SELECT 'agent' AS config, 'exact_match' AS metric, exact_match AS value FROM c WHERE slice = 'numeric' UNION ALL SELECT 'agent', 'abstention', abstention FROM c WHERE slice = 'unanswerable'),
f AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{m}', '{o}', {v})" for c, m, o, v in evals.FLOORS)}) AS t(config, metric, op, floor))
SELECT config, metric, op, CAST(floor AS DOUBLE) AS floor, value, coalesce(CASE WHEN op = '>=' THEN value >= floor ELSE value <= floor END, false) AS ok FROM f LEFT JOIN l USING (config, metric)""")  # fmt: skip
def scorecard_gate(spark, d):
    c = evals.scorecard(_outcomes(spark, d))
    m = evals.long_format(c.select("slice", "exact_match", "abstention"), ("slice",)).filter("(slice = 'numeric' and metric = 'exact_match') or (slice = 'unanswerable' and metric = 'abstention')")
    return evals.gate(m.select(F.lit("agent").alias("config"), "metric", "value"), evals.floors(spark))


@query("""WITH t AS (SELECT c_mktsegment AS config, c_acctbal AS seconds FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY seconds) AS rn, count(*) OVER (PARTITION BY config) AS n FROM t)
SELECT config, n, median(seconds) AS p50, max(seconds) FILTER (WHERE rn = greatest(1, least(n, CAST(round_even(0.95 * n, 0) AS BIGINT)))) AS p95 FROM r GROUP BY config, n""")  # fmt: skip
def timing_percentiles(spark, d):
    return evals.percentiles(table(spark, d, "customer").select(F.col("c_mktsegment").alias("config"), F.col("c_acctbal").alias("seconds")))


@query("""WITH r AS (SELECT n_name AS config, r_name AS lane, n_nationkey AS rung, max(c_acctbal) AS best, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
SELECT config, lane, rung, best, n, best - lag(best) OVER (PARTITION BY lane ORDER BY rung) AS best_delta, n - lag(n) OVER (PARTITION BY lane ORDER BY rung) AS n_delta FROM r""")  # fmt: skip
def ablation_deltas(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    g = j.groupBy(F.col("n_name").alias("config"), F.col("r_name").alias("lane"), F.col("n_nationkey").alias("rung")).agg(F.max("c_acctbal").alias("best"), F.count(F.lit(1)).alias("n"))
    return evals.ladder(g, ("best", "n"))


@query()
def capped_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return evals.capped_sample(c, {"c_nationkey": 5, "c_mktsegment": 20}, ["c_custkey"])


# -- events --------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, ts, event_type, epoch_us(ts) AS us FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM e)
SELECT event_type, event_id, ts, in_window FROM w WHERE in_window > 3""")  # fmt: skip
def rate_limit_audit(spark, d):
    return limits.rate_audit(table(spark, d, "events"), "event_type", 3, 3600.0)


@query("""WITH e AS (SELECT event_id, ts, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
w AS (SELECT *, CAST(sum(k) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS total, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM e)
SELECT event_type, event_id, ts, total, in_window FROM w WHERE total > 150 AND in_window > 1""")  # fmt: skip
def token_budget_audit(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return limits.budget_audit(e, "event_type", "k", 150, 3600.0)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def event_tumbling(spark, d):
    return limits.tumbling(table(spark, d, "events"), "1 hour", "event_type")


@query("""WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 AS INTEGER), 1) AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")  # fmt: skip
def event_sessions(spark, d):
    return limits.sessions(table(spark, d, "events"), "user_id", 3600)


_SPANS = "sp AS (SELECT event_id AS span_id, CASE WHEN event_id % 8 > 0 THEN event_id - event_id % 8 + (event_id % 8) // 2 END AS parent_id, ts FROM events)"


@query(f"""WITH RECURSIVE {_SPANS}, p AS (SELECT span_id, CASE WHEN parent_id IN (SELECT span_id FROM sp) THEN parent_id END AS parent_id, ts FROM sp),
n AS (SELECT span_id, parent_id, CAST(CASE WHEN parent_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY ts, span_id) END AS INTEGER) AS nth FROM p),
t(span_id, depth, path, nth) AS (SELECT span_id, 0, CAST(span_id AS VARCHAR), nth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.span_id, depth + 1, path || '/' || CAST(n.span_id AS VARCHAR), n.nth FROM n JOIN t ON n.parent_id = t.span_id) SELECT span_id, depth, path, nth FROM t""")
def trace_tree(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    return traces.depth(e.select(i.alias("span_id"), F.when(i % 8 > 0, i - i % 8 + F.floor((i % 8) / 2)).alias("parent_id"), "ts"), "ts")


@query("""SELECT event_type AS name, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS total_ms, max(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS max_ms, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY event_type""")
def span_counters(spark, d):
    e = table(spark, d, "events")
    return traces.counters(e.select(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status")))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS key FROM documents")
def normalised_texts(spark, d):
    return texts._docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("key"))
