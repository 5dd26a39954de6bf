"""Verification, the answering loop, limits and traces on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import answer, verify
from evidencelake.streaming import limits, traces

ANSWER = "qid long, answer string, question string, route string, refused boolean, grade_ok boolean, repairs int, repair_log array<string>"
EVIDENCE = "qid long, idx int, kind string, body string, citation string, accn string, value double, unit string, tag string, period_end string, ticker string, char_start int, char_end int"


def make(spark, *answers, evidence=()):
    a = spark.createDataFrame([(i, t, "In 2021?", "sql", False, True, 0, []) for i, t in enumerate(answers)], ANSWER)
    rows = [(i, k + 1, *e) for i in range(len(answers)) for k, e in enumerate(evidence)]
    return a, spark.createDataFrame(rows, EVIDENCE)


FACTS = [("fact", "Revenue 2023-01-29", "c", "acc", 60922e6, "USD", "Rev", "2024-01-28", "T", 0, 0), ("fact", "Revenue before", "c", "acc", 26974e6, "USD", "Rev", "2023-01-29", "T", 0, 0), ("text", "we recognised 16,434 in the quarter", "c", "acc", None, "", "", "", "T", 5, 90), ("text", "lost", "c", "", None, "", "", "", "T", 0, 0)]


def test_tiers(spark):
    said = ["It was $60.9 billion in 2024 [1].", "60,922 million", "16,434", "16.4 billion", "up 125.9% on the year", "a difference of 33,948 million", "2021 and 99", "$2,024 million in 2024", "Ended 2022-08-28 at 5 units"]
    a, e = make(spark, *said, evidence=FACTS)
    got = {}
    for r in verify.check_numbers(a, e).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.status, r.how))
    assert got[0] == [("supported", "scaled"), ("context", "period")]
    assert got[1] == [("supported", "scaled")]
    assert got[2] == [("supported", "digits")]
    assert got[3] == [("supported", "scaled")]
    assert got[4] == [("derived", "recomputed")]
    assert got[5] == [("derived", "recomputed")]
    assert got[6] == [("context", "question"), ("unsupported", "")]
    assert got[7][0] == ("unsupported", "") and got[7][1] == ("context", "period")
    assert [s for s, _ in got[8]] == ["unsupported", "unsupported"]


def test_citations_and_uncited(spark):
    a, e = make(spark, "One [1, 3] two [4] three [9] [1].", "None.", "Big 5. Small [1].", "Nothing 12 here. Fine.", evidence=FACTS)
    got = {r.qid: (r.made, r.dangling, r.unlocatable) for r in verify.citations(a, e).collect()}
    assert got[0] == ([1, 3], [9], [4]) and got[1] == ([], [], [])
    un = {r.qid: r.uncited for r in verify.uncited(a).collect()}
    assert un == {0: [], 1: ["None."], 2: ["Big 5."], 3: ["Nothing 12 here."]}


def test_verdict_guard_and_taxonomy(spark):
    a, e = make(spark, "It was 60,922 million [1].", "It was 70,000 million [1].", "It was 60,922 million [8].", evidence=FACTS)
    refusal = spark.createDataFrame([(7, answer.REFUSAL, "q", "text", True, False, 1, ["repair 1: sql found nothing; fall back to the text retriever"])], ANSWER)
    v = verify.verdicts(a.unionByName(refusal), e)
    got = {r.qid: (r.ok, r.taxonomy) for r in v.collect()}
    assert got == {0: (True, []), 1: (False, ["synthesis_drift", "grader_false_positive"]), 2: (False, ["grader_false_positive"]), 7: (True, ["retrieval_miss", "router_wrong"])}
    assert {r.qid: r.shipped for r in verify.guard(v, "block", "no").collect()}[1] == "no"
    assert not any(r.blocked for r in verify.guard(v, "flag").collect())
    with pytest.raises(ValueError):
        verify.guard(v, "loud")
    (r,) = verify.guard_report(verify.guard(v)).collect()
    assert (r.answers, r.verified, r.blocked, r.figures, r.unsupported, r.dangling) == (4, 2, 2, 3, 1, 1)
    assert {x.tag: x.n for x in verify.taxonomy_counts(v).collect()}["grader_false_positive"] == 2


def test_recheck(spark):
    a, e = make(spark, "It was 60,922 million [1].", "Nothing said.", evidence=FACTS[:1])
    stored = lambda v: spark.createDataFrame([(0, 1, v)], "qid long, idx int, val double")
    assert verify.recheck_facts(a, e, stored(60922e6)).first().unrechecked == []
    assert "no figure" in verify.recheck_facts(a, e, stored(5e9)).first().unrechecked[0]
    assert "no longer" in verify.recheck_facts(a, e, stored(1.0).limit(0)).first().unrechecked[0]


def test_mutations_are_caught(spark):
    a, e = make(spark, "It was 60,922 million [1].", evidence=FACTS)
    for r in verify.mutations(a).select("mutation", "answer").collect():
        m = a.withColumn("answer", F.lit(r.answer))
        assert not verify.verdicts(m, e).first().ok, r
    d = verify.decompose(a, verify.check_numbers(a, e)).collect()
    assert [(x.sentence, x.text, x.status) for x in d] == [("It was 60,922 million [1].", "60,922", "supported")]


STATE = "qid long, question string, text string, route string, ticker string, concept string, period_end string"


def test_plan_route_grade_repair(spark):
    q = spark.createDataFrame([(1, "What did A and NVDA file for 2024-01-28?"), (2, "nothing")], "qid long, question string")
    p = {r.qid: (r.ticker, r.period_end, r.route) for r in answer.heuristic_plan(q).collect()}
    assert p == {1: ("NVDA", "2024-01-28", "text"), 2: ("", "", "text")}
    s = spark.createDataFrame([(1, "q", "q", "sql", "T", "c", ""), (2, "q", "q", "sql", "T", "", ""), (3, "q", "q", "graph", "", "", ""), (4, "q", "q", "refuse", "", "", "")], STATE)
    assert {r.qid: (r.route, len(r.notes)) for r in answer.route(s, graph=False).collect()} == {1: ("sql", 0), 2: ("text", 1), 3: ("text", 1), 4: ("refuse", 0)}
    assert {r.qid: r.route for r in answer.route(s, sql=False, text=False, graph=False).collect()} == {1: "refuse", 2: "refuse", 3: "refuse", 4: "refuse"}
    e = spark.createDataFrame([(1, 1, "fact", None, "t", "", "T", 0.0), (5, 1, "text", None, "", "", "U", 1.0), (6, 1, "text", None, "", "", "T", -1.0), (7, 1, "fact", 5.0, "t", "d", "T", 0.0)], "qid long, idx int, kind string, value double, tag string, period_end string, ticker string, score double")
    g = spark.createDataFrame([(1, "q", "q", "sql", "T", "c", "2024-01-01"), (2, "q", "q", "text", "T", "c", ""), (4, "q", "q", "refuse", "", "", ""), (5, "q", "q", "text", "T", "", ""), (6, "q", "q", "text", "T", "c", ""), (7, "q", "q", "sql", "T", "c", "")], STATE)
    g = answer.grade(g.withColumn("repairs", F.lit(0)).withColumn("repair_log", F.array().cast("array<string>")), e)
    assert {r.qid: (r.ok, r.missing) for r in g.collect()} == {1: (False, "value"), 2: (False, "anything"), 4: (True, ""), 5: (False, "company"), 6: (False, "relevance"), 7: (True, "")}
    fixed = {r.qid: (r.route, r.text, r.period_end) for r in answer.repair(g.filter("not ok")).collect()}
    assert fixed == {1: ("sql", "q", ""), 2: ("text", "q c", ""), 5: ("text", "T q", ""), 6: ("text", "q c", "")}


def test_the_loop_is_bounded(spark):
    p = spark.createDataFrame([(1, "q", "q", "text", "", "", "")], STATE)
    calls = []

    def nothing(states):
        calls.append(1)
        return spark.createDataFrame([], "qid long, idx int, kind string, value double, unit string, tag string, period_end string, ticker string, score double, body string")

    done, shown = answer.run(p, nothing)
    (r,) = done.collect()
    assert (r.ok, r.repairs, len(calls)) == (False, 2, 3)
    (s,) = answer.synthesise(done, shown).collect()
    assert s.refused and s.answer == answer.REFUSAL


def test_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t0 + dt.timedelta(seconds=s), 10) for i, s in enumerate([0, 10, 20, 59, 60, 61, 200])]
    e = spark.createDataFrame(rows, "event_id long, k string, ts timestamp, n long")
    assert [(r.event_id, r.in_window) for r in limits.rate_audit(e, "k", 3).orderBy("event_id").collect()] == [(3, 4), (4, 4), (5, 5)]
    assert [r.event_id for r in limits.budget_audit(e, "k", "n", 35).orderBy("event_id").collect()] == [3, 4, 5]
    assert limits.budget_audit(e, "k", "n", 5).filter("event_id = 6").count() == 0
    assert [(r.n) for r in limits.sessions(e, "k", 60).orderBy("session").collect()] == [6, 1]


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "k string, event_id long, ts timestamp, value double"
    for b, rows in enumerate([[("a", 1, 0, 1.0), ("a", 2, 5, 2.0), ("a", 2, 6, 2.0)], [("a", 3, 400, 4.0), ("b", 4, 420, 1.0)], [("a", 5, 4000, 1.0)]]):
        spark.createDataFrame([(k, i, t0 + dt.timedelta(seconds=s), v) for k, i, s, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{b}"))
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(limits.streamed_windows(src(), "5 minutes", "1 minute", "k"), "w").collect()
    assert sorted((r.k, r.n, r.total) for r in got) == [("a", 1, 4.0), ("a", 3, 5.0), ("b", 1, 1.0)]
    assert drain(limits.once(src(), "event_id", "1 hour"), "o").count() == 5
    waits = sorted((r.ts, r.wait_s) for r in drain(limits.limiter(src().filter("k = 'a'"), "k", 2, 60.0), "l").collect())
    assert [round(w, 3) for _, w in waits] == [0.0, 0.0, 54.0, 0.0, 0.0]


def test_traces(spark):
    s = spark.createDataFrame([(1, None, "t", "root", 1_000_000, 9.0, "ok", {"a": "x"}), (2, 1, "t", "plan", 2_000_000, 1.0, "ok", {"a": "y"}), (3, 2, "t", "plan", 4_000_000, 2.0, "error", {})], "span_id long, parent_id long, trace_id string, name string, start_ns long, ms double, status string, attributes map<string,string>")
    assert {r.span_id: (r.depth, r.path) for r in traces.depth(s).collect()} == {1: (0, "1"), 2: (1, "1/2"), 3: (2, "1/2/3")}
    assert [r.offset_ms for r in traces.waterfall(s).orderBy("span_id").collect()] == [0.0, 1.0, 3.0]
    assert {r.name: (r.n, r.failed) for r in traces.counters(s).collect()} == {"root": (1, 0), "plan": (2, 1)}
    assert [r.span_id for r in traces.search(s, name="plan", a="y").collect()] == [2]
