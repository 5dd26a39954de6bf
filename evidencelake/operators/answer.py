"""The answering loop over a table of questions: plan, route, grade, repair, synthesise, with repairs unrolled.

A question's state is a row: qid, question, text, route, ticker, concept,
period_end, repairs, repair_log. Retrieval is given as a function from states to
evidence, so each pass is one job over all questions that still need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many repairs, how much evidence is shown, and the score below which text is irrelevant.
BUDGET, TOP_N, FLOOR = 2, 5, 0.0
REFUSAL = "INSUFFICIENT EVIDENCE"
ROUTES = ("sql", "text", "graph", "refuse")


def heuristic_plan(questions: DataFrame) -> DataFrame:
    """The floor under any planner: route text, the first ticker of two letters or more and the first ISO date."""
    found = F.filter(F.regexp_extract_all("question", F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1)), lambda t: F.length(t) >= 2)
    return questions.select(
        "qid", "question", F.col("question").alias("text"), F.lit("text").alias("route"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("ticker"),
        F.lit("").alias("concept"), F.regexp_extract("question", r"\b(\d{4}-\d{2}-\d{2})\b", 1).alias("period_end"),
    )


def route(plans: DataFrame, *, sql=True, text=True, graph=True, concepts: DataFrame | None = None) -> DataFrame:
    """Adds planned, route and notes. What isn't there is replaced: sql without a known concept by text, graph by text, text by refusal.

    concepts: qid of the questions whose concept resolves.
    """
    p = plans.withColumn("planned", F.col("route"))
    if concepts is None:
        known = F.col("concept") != ""
    else:
        p = p.join(concepts.select("qid").distinct().withColumn("_known", F.lit(True)), "qid", "left")
        known = F.coalesce("_known", F.lit(False)) & (F.col("concept") != "")
    bad_sql = (F.col("planned") == "sql") & (~F.lit(sql) | ~known)
    bad_graph = (F.col("planned") == "graph") & ~F.lit(graph)
    first = F.when(bad_sql | bad_graph, "text").otherwise(F.col("planned"))
    note = F.when((F.col("planned") == "sql") & ~F.lit(sql), "no facts store; sql -> text").when(bad_sql, F.concat(F.lit("'"), "concept", F.lit("' is not a registry concept; sql -> text"))).when(bad_graph, "no graph store; graph -> text")
    last = F.when((first == "text") & ~F.lit(text), "no retriever; text -> refuse")
    out = p.withColumn("route", F.when(last.isNotNull(), "refuse").otherwise(first)).withColumn("notes", F.array_compact(F.array(note, last)))
    return out.drop("_known")


def rerank_node(candidates: DataFrame, scorer=None, top_n: int = TOP_N) -> DataFrame:
    """The best ``top_n`` of each question's candidates: text by ``scorer`` if there is one, everything else in its order (idx)."""
    if scorer is not None:
        candidates = candidates.withColumn("score", F.when(F.col("kind") == "text", scorer).otherwise(F.col("score")))
        by = [F.when(F.col("kind") == "text", -F.col("score")).asc_nulls_last(), F.col("idx")]
    else:
        by = [F.col("idx")]
    w = Window.partitionBy("qid").orderBy(*by)
    return candidates.withColumn("idx", F.row_number().over(w)).filter(F.col("idx") <= top_n)


def grade(states: DataFrame, evidence: DataFrame) -> DataFrame:
    """``states`` with ok, reason and missing."""
    g = evidence.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.max("score").alias("top_score"), F.collect_set("ticker").alias("tickers"),
        F.min_by(F.struct("value", "tag", "period_end"), "idx").alias("first"),
    )
    s = states.join(g, "qid", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    stranger = (F.col("ticker") != "") & ~F.coalesce(F.array_contains("tickers", F.col("ticker")), F.lit(False))
    cases = [  # condition, ok, reason, missing
        (F.col("route") == "refuse", True, F.lit("router declined: no store can answer this"), ""),
        (F.col("n_evidence") == 0, False, F.lit("no evidence"), "anything"),
        ((F.col("route") == "sql") & F.col("first.value").isNull(), False, F.lit("row without a value"), "value"),
        (F.col("route") == "sql", True, F.concat(F.lit("fact found: "), F.coalesce("first.tag", F.lit("")), F.lit(" "), F.coalesce(F.col("first.period_end").cast("string"), F.lit(""))), ""),
        (F.col("route") == "graph", True, F.concat(F.col("n_evidence").cast("string"), F.lit(" edges")), ""),
        (stranger, False, F.concat(F.lit("no evidence from "), F.col("ticker")), "company"),
        (F.col("top_score") < FLOOR, False, F.lit("best score below the floor"), "relevance"),
        (F.lit(True), True, F.lit("best score over the floor"), ""),
    ]
    for i, name in enumerate(("ok", "reason", "missing")):
        e = None
        for c in cases:
            value = c[1 + i] if name == "reason" else F.lit(c[1 + i])
            e = F.when(c[0], value) if e is None else e.when(c[0], value)
        s = s.withColumn(name, e)
    return s.drop("top_score", "tickers", "first")


def repair(graded: DataFrame) -> DataFrame:
    """The next attempt of each failed state, as a table of cases; the new route is what the router sees."""
    n = F.col("repairs") + 1
    drop_period = (F.col("route") == "sql") & (n == 1) & (F.col("period_end") != "")
    company = (F.col("route") == "text") & (F.col("missing") == "company") & (F.col("ticker") != "")
    concept = (F.col("route") == "text") & ~company & (F.col("concept") != "")
    note = (
        F.when(drop_period, "drop the period and take the most recent filing")
        .when(F.col("route") == "sql", "sql found nothing; fall back to the text retriever")
        .when(F.col("route") == "graph", "graph found nothing; fall back to the text retriever")
        .when(company, F.concat(F.lit("re-query with the ticker in front: "), F.col("ticker")))
        .when(concept, "re-query with the concept appended")
        .otherwise("no repair left to try")
    )
    text = F.when(company, F.concat_ws(" ", "ticker", "text")).when(concept, F.concat_ws(" ", "text", "concept")).otherwise(F.col("text"))
    return (
        graded.withColumn("_note", F.concat(F.lit("repair "), n.cast("string"), F.lit(": "), note))
        .withColumn("_route", F.when(drop_period, "sql").otherwise("text"))
        .withColumn("_text", text)
        .withColumn("_period", F.when(drop_period, "").otherwise(F.col("period_end")))
        .select(
            "qid", "question", F.col("_text").alias("text"), F.col("_route").alias("route"), "ticker", "concept", F.col("_period").alias("period_end"),
            n.alias("repairs"), F.concat("repair_log", F.array("_note")).alias("repair_log"),
        )
    )


def run(plans: DataFrame, retrieve: Callable[[DataFrame], DataFrame], *, budget: int = BUDGET, concepts: DataFrame | None = None, **stores) -> tuple[DataFrame, DataFrame]:
    """(final states with grades, their evidence) after at most ``budget`` repairs, each a pass over what failed."""
    state = plans.withColumn("repairs", F.lit(0)).withColumn("repair_log", F.array().cast("array<string>"))
    done, kept = None, None
    for attempt in range(budget + 1):
        routed = route(state, concepts=concepts, **stores)
        routed = routed.withColumn("repair_log", F.concat("repair_log", "notes")).drop("notes", "planned")
        evidence = retrieve(routed)
        graded = grade(routed, evidence)
        last = attempt == budget
        over = graded if last else graded.filter("ok")
        shown = evidence.join(over.select("qid"), "qid", "left_semi")
        done, kept = (over, shown) if done is None else (done.unionByName(over), kept.unionByName(shown))
        if not last:
            state = repair(graded.filter("not ok"))
    return done, kept


def synthesise(states: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, answer, refused: without a model, the first fact or passage with its citation mark; a refusal where the grade failed."""
    body = F.min_by(F.struct("kind", "value", "unit", "tag", "period_end", "ticker", "body"), "idx").alias("e")
    first = evidence.groupBy("qid").agg(body)
    s = states.join(first, "qid", "left")
    fact = F.concat(F.col("e.ticker"), F.lit(" reported "), F.col("e.tag"), F.lit(" of "), F.format_number("e.value", 0), F.lit(" "), F.coalesce("e.unit", F.lit("")), F.lit(" for the period ending "), F.col("e.period_end").cast("string"), F.lit(" [1]."))
    text = F.concat(F.get(F.split("e.body", r"(?<=[.!?])\s+"), F.lit(0)), F.lit(" [1]"))
    refused = (F.col("route") == "refuse") | ~F.col("ok") | F.col("e").isNull()
    return s.select("qid", "question", "route", "repairs", "repair_log", F.col("ok").alias("grade_ok"), F.when(refused, REFUSAL).when(F.col("e.kind") == "fact", fact).otherwise(text).alias("answer"), refused.alias("refused"))


def outcome_state(outcomes: DataFrame) -> DataFrame:
    """Adds state: error, blocked, abstained or answered, in this order."""
    s = F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("blocked"), "blocked").when(F.col("refused"), "abstained").otherwise("answered")
    return outcomes.withColumn("state", s)


def planned_route(route_col="route", has_spans="has_spans"):
    """The store the planner chose, read from an outcome: a refusal over spans was text; null where it can't be told."""
    return F.when(F.col(route_col).isin("sql", "text", "graph"), F.col(route_col)).when((F.col(route_col) == "refuse") & F.col(has_spans), "text")
