"""Stores, ingest, rendering, places and gates on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidencelake import __main__ as cli
from evidencelake.functions import render
from evidencelake.operators import evals, gates, locate
from evidencelake.sources import stores


def test_staging_keeps_null_and_empty_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", 'q"\\,x')], "k string, v string")
    stores.stage_csv(df, str(tmp_path / "s"))
    assert {tuple(r) for r in stores.read_staged(spark, str(tmp_path / "s"), "k string, v string").collect()} == {tuple(r) for r in df.collect()}
    df.write.parquet(str(tmp_path / "a"))
    assert stores.copy(spark, str(tmp_path / "a"), str(tmp_path / "b")) == 3


def test_vector_store_names(spark, tmp_path):
    name = stores.store_name("local", "org/model.v1", 2, "naive")
    assert name == "vectors__local__org_model-v1__2__naive"
    spark.createDataFrame([("x", [1.0, 0.0])], "chunk_id string, vector array<double>").write.parquet(str(tmp_path / name))
    assert stores.open_store(spark, str(tmp_path), name, 2).count() == 1
    for n, dim in ((name, 3), ("nope", 2)):
        with pytest.raises(LookupError):
            stores.open_store(spark, str(tmp_path), n, dim)


def test_embedding_resumes(spark):
    chunks = spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("c", "")], "chunk_id string, text string")
    have = spark.createDataFrame([("a",)], "chunk_id string")
    got = {r.chunk_id: r.vector for r in stores.embed_missing(chunks, have, lambda t: [[float(len(x)), 0.0] for x in t], batch=1).collect()}
    assert got == {"b": [1.0, 0.0], "c": [0.0, 0.0]}


def test_failures_are_rows(spark):
    def fetch(k):
        if k == "bad":
            raise OSError("gone")
        return k.encode()

    keys = spark.createDataFrame([("a",), ("bad",), ("b",)], "k string")
    got = {r.k: (r.sha256 is not None, r.error) for r in stores.ingest(keys, keys.filter("k = 'b'"), "k", fetch).collect()}
    assert got == {"a": (True, None), "bad": (False, "OSError: gone")}
    q = spark.createDataFrame([(1, "x"), (2, "")], "qid long, question string")
    out = {r.qid: (r.answer, r.error) for r in stores.run_questions(q, lambda r: {"answer": r["question"][0]}, "answer string").collect()}
    assert out[1] == ("x", "") and out[2][0] is None and "IndexError" in out[2][1]


def test_results_of_partial_runs(tmp_path):
    assert stores.write_results(str(tmp_path), "agent", {"b": 1}, "# x\n").endswith("agent")
    stores.write_results(str(tmp_path), "agent", {"b": 2}, "# y\n", partial=True)
    assert json.loads((tmp_path / "agent.json").read_text()) == {"b": 1} and (tmp_path / "agent-partial.md").exists()


def test_rendering(spark):
    r = spark.createDataFrame([(999, -1_234_567.0), (2_500_000, 12.0)], "n long, v double").select(render.size(F.col("n")), render.money(F.col("v"))).collect()
    assert [tuple(x) for x in r] == [("999 B", "-$1.2M"), ("2.50 MB", "$12.00")]
    assert render.escape('<a "b">') == "&lt;a &quot;b&quot;&gt;"
    assert render.fragment_link("u", "a b c") == "u#:~:text=a%20b%20c"
    assert render.fragment_link("u", " ".join("abcdefghijklmn"), 2) == "u#:~:text=a%20b,m%20n"
    assert render.markdown(spark.createDataFrame([("a|b", None, 0.5)], "x string, y int, z double")) == "| x | y | z |\n|---|---|---|\n| a\\|b |  | 0.5 |\n"


def test_values_stand_by_themselves(spark):
    facts = spark.createDataFrame([("d", 1_234_567.0), ("d", 98_765.0), ("d", 5.0), ("e", 4444.0)], "accn string, val double")
    docs = spark.createDataFrame([("d", "We had 1,234,567 and 11,234,567; (98,765) x98765 and 98,765.5."), ("e", "4444 " * 9)], "accn string, text string")
    got = {r.val: (r.rendering, [(h.start, h.end) for h in r.hits]) for r in locate.values(facts, docs).collect()}
    t = docs.first().text
    assert got[1_234_567.0] == ("1,234,567", [(7, 16)])
    assert got[98_765.0][0] == "98,765" and [t[a:b] for a, b in got[98_765.0][1]] == ["98,765"]
    assert set(got) == {1_234_567.0, 98_765.0}


def test_gates(spark):
    f = spark.createDataFrame([("1", "a", "p"), ("1", "b", "q")], "cik string, accn string, path string")
    co = spark.createDataFrame([("1",), ("2",)], "cik string")
    got = {r.check: r.ok for r in gates.corpus(co, f, co.limit(1), f.select("path"), least=2, per_company=1).collect()}
    assert got == {"corpus size": True, "manifest matches disk": True, "payload for every company": False, "filings for every company": False}
    tags = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "qid long, tags array<string>")
    assert gates.gallery(tags).first().ok and not gates.gallery(tags.filter("qid = 2")).first().ok
    out = spark.createDataFrame([(1, "split", None), (2, "degraded", "x")], "accn long, status string, reason string")
    ch = spark.createDataFrame([("i",), ("i",)], "chunk_id string")
    assert {r.check: r.ok for r in gates.texts(out, ch, ch.limit(0), 0.9, indexed=ch.limit(1), edge_audit=ch).collect()} == {
        "documents split": False, "documents without a reason": True, "chunk ids are unique": False, "chunks are slices": True, "the index has the chunks": True, "edges quote their sentence": False}


def test_nested_scores_and_draws(spark):
    card = {"hit": {"10": 0.5, "5": None}, "n": 3, "ok": True}
    assert evals.flatten(card) == {"hit.10": 0.5, "hit.5": None, "n": 3, "ok": True}
    assert evals.dig(card, "hit.10") == 0.5 and evals.dig(card, "hit.5") is None and evals.dig(card, "ok") is None and evals.dig(card, "x.y") is None
    assert evals.seeded_sample([3, 1, 2], 2, 7) == evals.seeded_sample([1, 2, 3], 2, 7)
    assert evals.configs(spark).filter("not generate").count() == 3


def test_cli(capsys, tiny, spark):
    assert cli.main(["list"]) == 0 and "* facts_current" in capsys.readouterr().out
    assert cli.main(["run", "duplicate_keys", tiny, "--limit", "2"]) == 0


def test_universe_files(spark, tmp_path):
    from evidencelake.sources import filings

    body = {"companies": [{"ticker": "aa", "name": "A", "cik": 7}, {"ticker": "bb"}, {"ticker": "cc"}], "forms": ["10-K"], "window": {"from": "2020-01-01", "to": "2021-01-01"}}
    (tmp_path / "u.json").write_text(json.dumps(body))
    companies, forms, window = filings.read_universe(spark, str(tmp_path / "u.json"))
    assert forms == ["10-K"] and window == ("2020-01-01", "2021-01-01")
    known = spark.createDataFrame([("bb", 5), ("cc", 9)], "ticker string, cik long")
    assert {r.ticker: r.cik for r in filings.resolved(companies, known).collect()} == {"AA": "0000000007", "BB": "0000000005", "CC": "0000000009"}
    with pytest.raises(LookupError, match="no cik for BB, CC"):
        filings.resolved(companies, known.limit(0))
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError, match="declares no universe"):
        filings.read_universe(spark, str(tmp_path / "bad.json"))


def test_reports(spark):
    from evidencelake.functions import render

    df = spark.createDataFrame([("a", 1.5), ("b|c", None)], "name string, v double")
    assert render.report("Corpus", {"Rows": df, "None": df.limit(0)}, ("made up",)) == "# Corpus\n\n## Rows\n\n| name | v |\n|---|---|\n| a | 1.5 |\n| b\\|c |  |\n\n## None\n\nNothing to show.\n\n- made up\n"
