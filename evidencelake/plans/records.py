"""Queries over sources, sinks and the small functions that answers are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import numbers as N
from evidencelake.functions import render, spans
from evidencelake.functions import text as T
from evidencelake.operators import answer, chunking, evals, facts, gates, lookup, relations, verify
from evidencelake.operators.metrics import Metric
from evidencelake.plans.texts import _docs
from evidencelake.sources import datasets, filings, manifest, stores, xbrl
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


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# -- indexes, universes and payloads -------------------------------------


@query("SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS title FROM supplier")
def ticker_map(spark, d):
    """One object of objects for each nation, as rows."""
    entry = F.struct(F.col("s_suppkey").cast("long").alias("cik_str"), F.concat(F.lit("s"), _s("s_suppkey")).alias("ticker"), F.col("s_name").alias("title"))
    whole = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(_s("s_suppkey"), entry)))).alias("payload"))
    return filings.ticker_map(whole)


@query("""SELECT lpad(CAST(o_custkey % 50 AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accn, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form,
  CAST(CAST(o_orderdate AS DATE) + 40 AS VARCHAR) AS filed, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period, 'd' || CAST(o_orderkey AS VARCHAR) || '.htm' AS doc, o_orderkey * 10 AS size
FROM orders WHERE o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND o_orderkey % 7 <> 0""")
def filing_index(spark, d):
    """Parallel arrays of a filing index zipped, and the filings of two forms in a window that have a document."""
    o = table(spark, d, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    day = F.col("o_orderdate").cast("date")
    row = F.struct(_s("o_orderkey").alias("accessionNumber"), form.alias("form"), _s(F.date_add(day, 40)).alias("filingDate"), _s(day).alias("reportDate"),
                   F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("d"), _s("o_orderkey"), F.lit(".htm"))).alias("primaryDocument"), (F.col("o_orderkey") * 10).alias("size"))
    g = o.groupBy(F.lpad(_s(F.col("o_custkey") % 50), 10, "0").alias("cik")).agg(F.collect_list(row).alias("r")).select("cik", *[F.col(f"r.{a}").alias(a) for a in filings.ARRAYS])
    return filings.select_filings(filings.zip_index(g, "cik"), ["10-K", "10-Q"], "1995-01-01", "1996-12-31")


_SPEC = {
    "companies": [{"ticker": f"s{i}", "name": f"Company {i}", "sector": "x", **({"cik": 900 + i} if i % 3 == 0 else {})} for i in range(1, 9)] + [{"ticker": "none", "name": "Nowhere"}],
    "forms": ["10-K"], "window": {"from": "1995-01-01", "to": "1996-12-31"},
}


@query("""SELECT upper(t) AS ticker, CASE WHEN i % 3 = 0 THEN lpad(CAST(900 + i AS VARCHAR), 10, '0') WHEN s_suppkey IS NOT NULL THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik
FROM (SELECT 's' || CAST(i AS VARCHAR) AS t, i FROM range(1, 9) r(i) UNION ALL SELECT 'none', 1) LEFT JOIN supplier ON upper(t) = 'S' || CAST(s_suppkey AS VARCHAR)""")
def cik_resolution(spark, d):
    """A declared universe: its own ciks win, the ticker map has the others, and one is in neither."""
    return filings.resolve_ciks(filings.universe(spark, _SPEC)[0], ticker_map(spark, d)).select("ticker", "cik")


def _payloads(spark, d):
    """A payload of each nation: parts' types as tags, with a label that the first nation in order decides."""
    entry = "array<struct<val:string>>"
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = j.groupBy("s_nationkey", "p_type").agg(F.count(F.lit(1)).alias("n"))
    body = F.struct(F.concat(F.col("p_type"), F.lit(" of "), _s("s_nationkey")).alias("label"), F.lit("text").alias("description"), F.map_from_arrays(F.array(F.lit("USD")), F.array(F.array().cast(entry))).alias("units"))
    tags = t.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("p_type", body))).alias("tags"))
    return tags.select(F.lpad(_s("s_nationkey"), 10, "0").alias("cik"), F.lpad(_s("s_nationkey"), 3, "0").alias("ticker"), F.to_json(F.struct(F.map_from_arrays(F.array(F.lit("us-gaap")), F.array("tags")).alias("facts"))).alias("payload"))


_NATION_TAGS = "nt AS (SELECT DISTINCT s_nationkey, p_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_NATION_TAGS} SELECT 'us-gaap' AS taxonomy, p_type AS tag, p_type || ' of ' || CAST(min(s_nationkey) AS VARCHAR) AS label, 'text' AS description FROM nt GROUP BY p_type")
def concept_dictionary(spark, d):
    return xbrl.concepts(_payloads(spark, d))


@query(f"WITH {_NATION_TAGS} SELECT lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, CAST(count(*) AS INTEGER) AS n FROM nt GROUP BY s_nationkey")
def concept_counts(spark, d):
    return _payloads(spark, d).select("cik", xbrl.concept_count(F.col("payload")).alias("n"))


# -- stores and runs -----------------------------------------------------


def _scratch(spark, name: str) -> str:
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_STAGED = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a "quoted", ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS val FROM customer"""


@query(_STAGED)
def staged_facts(spark, d):
    """Rows through the CSV staging and a copied store: null, empty and quoted stay apart."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 1, "").when(k % 4 == 2, F.concat(F.lit('a "quoted", '), "c_name")).when(k % 4 == 3, F.col("c_name")).alias("name"), F.when(k % 5 > 0, F.col("c_acctbal")).alias("val"))
    at = _scratch(spark, "staged")
    stores.stage_csv(c, f"{at}/csv")
    stores.read_staged(spark, f"{at}/csv", c.schema.simpleString()[7:-1].replace(":", " ")).write.parquet(f"{at}/first")
    stores.copy(spark, f"{at}/first", f"{at}/second")
    return spark.read.parquet(f"{at}/second")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS accn, CASE WHEN c_custkey % 7 > 0 THEN sha256('body of ' || CAST(c_custkey AS VARCHAR)) END AS sha256,
  CASE WHEN c_custkey % 7 = 0 THEN 'OSError: ' || CAST(c_custkey AS VARCHAR) END AS error FROM customer WHERE c_custkey % 3 <> 0""")
def ingest_rows(spark, d):
    """What isn't there yet is fetched; a failure is a row."""

    def fetch(key: str) -> bytes:
        if int(key) % 7 == 0:
            raise OSError(key)
        return f"body of {key}".encode()

    want = table(spark, d, "customer").select(_s("c_custkey").alias("accn"), "c_custkey")
    got = stores.ingest(want.select("accn").unionByName(want.select("accn")), want.filter("c_custkey % 3 = 0").select("accn"), "accn", fetch)
    return got.select("accn", "sha256", "error")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS accn, 'raw/' || CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 4 = 0 AS lost FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def existence_checks(spark, d):
    """Filings whose file isn't there, and those that are wanted and not in the manifest."""
    o = table(spark, d, "orders").select(_s("o_orderkey").alias("accn"), F.concat(F.lit("raw/"), _s("o_orderkey")).alias("path"), "o_orderkey")
    lost = manifest.missing_files(o, o.filter("o_orderkey % 4 <> 0")).withColumn("lost", F.lit(True))
    new = manifest.fresh(o, o.filter("o_orderkey % 5 <> 0"), "accn").filter("o_orderkey % 4 <> 0").withColumn("lost", F.lit(False))
    return lost.select("accn", "path", "lost").unionByName(new.select("accn", "path", "lost"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS accn, CAST(trunc(o_totalprice * 100) AS BIGINT) AS bytes FROM orders ORDER BY trunc(o_totalprice * 100) DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def largest_filings(spark, d):
    return manifest.largest(table(spark, d, "orders").select(_s("o_orderkey").alias("accn"), (F.col("o_totalprice") * 100).cast("long").alias("bytes")), 20)


@query("SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 11 > 0 THEN 'it is ' || CAST(o_custkey AS VARCHAR) END AS answer, CASE WHEN o_orderkey % 11 = 0 THEN 'ValueError: ' || CAST(o_custkey AS VARCHAR) ELSE '' END AS error FROM orders")
def question_runs(spark, d):
    """A runner over questions, with errors caught as rows."""

    def reply(q: dict) -> dict:
        if q["qid"] % 11 == 0:
            raise ValueError(q["who"])
        return {"answer": f"it is {q['who']}"}

    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("who"))
    return stores.run_questions(q, reply, "answer string").drop("seconds")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)")
def outcome_cache(spark, d):
    """Questions to be asked again: those without an outcome of this fingerprint, and failed ones."""
    o = table(spark, d, "orders")
    done = o.select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise("old").alias("fingerprint"), F.when(F.col("o_custkey") % 2 == 1, "failed").alias("error"))
    return datasets.cached(done, o.select(F.col("o_orderkey").alias("id")), "new")


@query("""SELECT c_custkey AS chunk_id, round(length(c_name) / sqrt(length(c_name) * length(c_name) + 9.0), 9) AS x, round(3 / sqrt(length(c_name) * length(c_name) + 9.0), 9) AS y FROM customer WHERE c_custkey % 4 <> 1""")
def vectors_of_new_chunks(spark, d):
    """Unit vectors for the chunks that have none yet."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("text"))
    v = stores.embed_missing(c, c.filter("chunk_id % 4 = 1"), lambda t: [[float(len(x)), 3.0] for x in t])
    return v.select("chunk_id", F.round(F.col("vector")[0], 9).alias("x"), F.round(F.col("vector")[1], 9).alias("y"))


# -- question sets -------------------------------------------------------


@query("""WITH o AS (SELECT CAST(o_orderkey // 2 AS VARCHAR) AS id, o_orderkey % 4 AS k, o_orderkey % 6 AS m FROM orders),
r AS (SELECT id, 'unknown slice' AS rule FROM o WHERE k = 3 UNION ALL SELECT id, 'empty question' FROM o WHERE m = 5 UNION ALL SELECT id, 'no provenance' FROM o WHERE m = 4
UNION ALL SELECT id, 'numeric without a value' FROM o WHERE k = 0 AND m IN (1, 2) UNION ALL SELECT id, 'numeric without a unit' FROM o WHERE k = 0 AND m = 3 UNION ALL SELECT id, 'numeric without a span' FROM o WHERE k = 0 AND m = 2
UNION ALL SELECT id, 'narrative without a span' FROM o WHERE k = 1 AND m = 2 UNION ALL SELECT id, 'unanswerable with spans' FROM o WHERE k = 2 AND m <> 2 UNION ALL SELECT id, 'unanswerable with a value' FROM o WHERE k = 2 AND m NOT IN (1, 2)
UNION ALL SELECT id, 'empty span' FROM o WHERE m = 0) SELECT * FROM r UNION ALL SELECT id, 'repeated id' FROM o GROUP BY id HAVING count(*) > 1""")
def question_rules(spark, d):
    k, m = F.col("o_orderkey") % 4, F.col("o_orderkey") % 6
    slices = F.when(k == 0, "numeric").when(k == 1, "narrative").when(k == 2, "unanswerable").otherwise("other")
    span = F.struct(F.lit("a").alias("accn"), F.lit(3).alias("char_start"), F.when(m == 0, 3).otherwise(9).alias("char_end"), F.lit("q").alias("quote"))
    q = table(spark, d, "orders").select(
        _s(F.floor(F.col("o_orderkey") / 2)).alias("id"), slices.alias("slice"), F.when(m == 5, " ").otherwise("what?").alias("question"), F.when(~m.isin(1, 2), F.lit(1.5)).alias("value"),
        F.when(m == 3, "").otherwise("USD").alias("unit"), F.when(m != 2, F.array(span)).otherwise(F.array().cast(f"array<{datasets.SPAN}>")).alias("spans"), F.when(m == 4, "").otherwise("o").alias("origin"), F.lit("g").alias("gold_source"),
    )
    return datasets.violations(q)


@query("""WITH s AS (SELECT doc_id, text, doc_id % 5 AS k FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN k = 3 THEN 'gone' ELSE CAST(doc_id AS VARCHAR) END AS accn, CAST(CASE WHEN k = 2 THEN -1 ELSE 1 END AS INTEGER) AS char_start,
  CASE WHEN k = 3 THEN 'no such document' WHEN k = 2 OR length(text) < 4 THEN 'out of range' ELSE 'another quote' END AS problem
FROM s WHERE k IN (1, 2, 3) OR length(text) < 4""")
def span_checks(spark, d):
    """Gold spans against their documents: three in five are broken, each in its way."""
    k = F.col("doc_id") % 5
    span = F.struct(F.when(k == 3, "gone").otherwise(_s("doc_id")).alias("accn"), F.when(k == 2, -1).otherwise(1).alias("char_start"), F.lit(4).alias("char_end"), F.when(k == 1, "\x07").otherwise(F.substring("text", 2, 3)).alias("quote"))
    docs = _docs(spark, d)
    return datasets.verify_spans(docs.select(_s("doc_id").alias("id"), F.array(span).alias("spans")), docs.select(_s("doc_id").alias("accn"), "text"))


@query("SELECT 'failure tags add up' AS \"check\", true AS ok, CAST(sum(o_orderkey % 3) AS VARCHAR) || '/' || CAST(count(*) FILTER (WHERE o_orderkey % 3 > 0) AS VARCHAR) AS detail FROM orders")
def gallery_check(spark, d):
    tags = F.array_repeat(F.lit("drift"), (F.col("o_orderkey") % 3).cast("int"))
    return gates.gallery(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), tags.alias("tags")))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in evals.CONFIGS) + ") AS t(config, system, generate, rerank, verify, guard)")
def experiment_registry(spark, d):
    return evals.configs(spark)


# -- texts, citations and keys -------------------------------------------


@query("""SELECT o_orderkey AS qid, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 7 AS VARCHAR) || 'A' ELSE 'I.' || CAST(o_custkey % 7 AS VARCHAR) || 'A' END AS item_key,
  'C' || CAST(o_custkey AS VARCHAR) || ' 10-K ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' -- Item ' || CAST(o_custkey % 7 AS VARCHAR) || 'A' || CASE WHEN o_custkey % 2 = 0 THEN '. ' || o_orderpriority ELSE '' END || chr(10) || chr(10) || o_orderpriority AS embed,
  CAST(greatest(1, length(o_orderpriority) // 4) AS BIGINT) AS tokens, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'https://x.example/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '01/d.htm' END AS url,
  'C' || CAST(o_custkey AS VARCHAR) || ' 10-K ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' Item 1A' END || ' [' || CAST(o_orderkey AS VARCHAR) || '-01 5:90]' AS text_cite,
  'C' || CAST(o_custkey AS VARCHAR) || ' 10-K ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' Tag [' || CAST(o_orderkey AS VARCHAR) || '-01]' AS fact_cite FROM orders""")
def passage_headers(spark, d):
    """Item keys, headers for embedding, token estimates, padded ciks, links and citations."""
    o = table(spark, d, "orders")
    item = F.concat(_s(F.col("o_custkey") % 7), F.lit("A"))
    ticker, day, accn = F.concat(F.lit("C"), _s("o_custkey")), _s(F.col("o_orderdate").cast("date")), F.concat(_s("o_orderkey"), F.lit("-01"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("qid"), T.item_key(F.when(F.col("o_custkey") % 3 == 0, "").otherwise("I"), item).alias("item_key"),
        T.embed_text(ticker, F.lit("10-K"), day, item, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.col("o_orderpriority")).alias("embed"),
        T.estimate_tokens(F.col("o_orderpriority")).alias("tokens"), T.cik10(F.concat(F.lit(" cik"), _s("o_custkey"))).alias("cik"),
        T.archive_url("https://x.example/", _s("o_custkey"), accn, F.when(k % 5 == 0, "").otherwise("d.htm")).alias("url"),
        T.text_citation(ticker, F.lit("10-K"), day, F.when(k % 4 == 0, T.WHOLE_DOCUMENT).otherwise("1A"), accn, F.lit(5), F.lit(90)).alias("text_cite"), T.fact_citation(ticker, F.lit("10-K"), F.col("o_orderdate").cast("date"), F.lit("Tag"), accn).alias("fact_cite"),
    )


@query("SELECT o_orderkey AS id, form FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-q' ELSE '8-K' END AS form, CAST(o_custkey % 4 AS VARCHAR) AS item_key FROM orders) WHERE form = '8-K' OR (form = '10-K' AND item_key IN ('1', '2')) OR (form = '10-q' AND item_key = '3')")
def narrative_rows(spark, d):
    """Rows of the sections that are told in prose; forms without a list pass."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-q").otherwise("8-K")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), form.alias("form"), _s(F.col("o_custkey") % 4).alias("item_key"))
    allowed = spark.createDataFrame([("10-K", "1"), ("10-K", "2"), ("10-Q", "3")], "form string, item_key string")
    return chunking.narrative(rows, allowed).select("id", "form")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_shipdate AS DATE) WHEN 2 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem")
def tolerant_dates(spark, d):
    """Dates from text: bare, with a time after, none at all, and no date."""
    n, day = F.col("l_linenumber") % 4, _s(F.col("l_shipdate").cast("date"))
    text = F.when(n == 1, day).when(n == 2, F.concat(F.lit(" "), day, F.lit("T10:00:00Z"))).when(n == 3, "31/12/1999")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", spans.iso_date(text).alias("day"))


@query("""WITH w AS (SELECT p_partkey, ['large', 'brass', 'item'] AS want, [x FOR x IN list_distinct(regexp_extract_all(lower(p_name || ' of the ' || p_type || ' brass'), '[a-z0-9]+')) IF x NOT IN ('the', 'a', 'an', 'of', 'for', 'and', 'at', 'in', 'on', 'to', 's')] AS have FROM part)
SELECT p_partkey, round(len(list_intersect(want, have)) / 3 - 0.01 * len([x FOR x IN have IF x NOT IN ('large', 'brass', 'item')]), 9) AS score FROM w""")
def overlap_scores(spark, d):
    have = T.token_set(F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" brass")))
    return table(spark, d, "part").select("p_partkey", F.round(T.overlap_score(T.token_set(F.lit("the large brass item")), have), 9).alias("score"))


@query("""SELECT o_orderkey, sha256('{"k":5,"model":"m","q":"' || o_orderpriority || '","w":' || CAST(o_custkey AS VARCHAR) || '}') AS key FROM orders""")
def cache_keys(spark, d):
    """SHA-256 of compact JSON with its keys in order."""
    whole = F.to_json(F.struct(F.lit(5).alias("k"), F.lit("m").alias("model"), F.col("o_orderpriority").alias("q"), F.col("o_custkey").alias("w")))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(whole, 256).alias("key"))


@query("""SELECT o_orderkey, o_orderkey % 4 < 3 AS ok FROM orders""")
def numeric_matches(spark, d):
    """Answers that state the value plainly, in thousands, with a scale word, or another one."""
    k, v = F.col("o_orderkey") % 4, (F.col("o_custkey") + 100) * 1000
    said = F.when(k == 0, F.concat(F.lit("It was $"), F.format_number(v, 0), F.lit("."))).when(k == 1, F.concat(F.lit("Revenue of "), _s(v / 1000), F.lit(" overall"))).when(k == 2, F.concat(F.lit("about "), _s(v / 1000), F.lit(" thousand dollars"))).otherwise(
        F.concat(F.lit("It was $"), F.format_number(v * 3 + 7, 0)))
    return table(spark, d, "orders").select("o_orderkey", N.numeric_match(said, v.cast("double")).alias("ok"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2,1' WHEN 1 THEN '' ELSE '3' END AS marks FROM orders")
def narrow_markers(spark, d):
    """The narrower reader of citation marks: single numbers in any of four brackets, as far as passages were shown."""
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "one [2] and 【1】 and [2]").when(k == 1, "none [1, 2] [77] (3)").otherwise("［3］ at last [0]")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.single_markers(said, F.lit(5)), ",").alias("marks"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE '{"route": "sql", "n": ' || CAST(o_custkey AS VARCHAR) || '}' END AS reply FROM orders""")
def reply_objects(spark, d):
    """The JSON object of a model's reply: bare, fenced, in prose, or broken."""
    k, body = F.col("o_orderkey") % 4, F.concat(F.lit('{"route": "sql", "n": '), _s("o_custkey"), F.lit("}"))
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise('{"route": ')
    return table(spark, d, "orders").select("o_orderkey", T.json_object(said).alias("reply"))


@query("""SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN trim(regexp_replace(substr(text, greatest(1, strpos(text, 'the') - 20), 40), '\\s+', ' ', 'g')) ELSE '' END AS quote FROM documents""")
def passage_quotes(spark, d):
    return _docs(spark, d).select("doc_id", T.quote(F.col("text"), "the", 40).alias("quote"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1e6 THEN format('{:,.2f} MB', b / 1e6) WHEN b >= 1e3 THEN format('{:,.2f} kB', b / 1e3) ELSE format('{:,} B', b) END AS size,
  CASE WHEN neg THEN '-' ELSE '' END || '$' || CASE WHEN b >= 1e6 THEN format('{:,.1f}M', b / 1e6) WHEN b >= 1e3 THEN format('{:,.1f}K', b / 1e3) ELSE format('{:,.2f}', CAST(b AS DOUBLE)) END AS money
FROM (SELECT o_orderkey, (o_orderkey * 1024 + 512) % 4194304 AS b, o_orderkey % 2 = 1 AS neg FROM orders)""")
def shown_figures(spark, d):
    """Sizes and amounts as reports print them (all are exact in binary, so nothing hangs on rounding halves)."""
    b = (F.col("o_orderkey") * 1024 + 512) % 4194304
    return table(spark, d, "orders").select("o_orderkey", render.size(b).alias("size"), render.money(F.when(F.col("o_orderkey") % 2 == 1, -b).otherwise(b)).alias("money"))


# -- concepts, evidence and relations ------------------------------------

_KNOWN = (Metric("revenue", "Net revenue", "flow", "USD", ("LARGE", "MEDIUM")), Metric("assets", "Total assets", "stock", "USD", ("SMALL",)), Metric("cash", "Cash", "stock", "USD", ("PROMO",)))
_PHRASES = ["LARGE goods.", "me dium", "Net revenue", "assets", "goods of promo kind", "small and dear goods", "zebra", "the of", ""]


@query("""SELECT o_orderkey AS qid, 'us-gaap' AS taxonomy, tag, lower(tag) || ' goods' AS label, metric, score, how, CAST(1 AS INTEGER) AS rank FROM orders JOIN (VALUES (0, 'LARGE', 'revenue', 1.0, 'exact-label'), (1, 'MEDIUM', 'revenue', 1.0, 'exact-tag'),
  (2, 'LARGE', 'revenue', 1.0, 'metric-label'), (3, 'SMALL', 'assets', 1.0, 'metric-label'), (4, 'PROMO', 'cash', round(2 / 3, 4), 'overlap'), (5, 'SMALL', 'assets', round(2 / 3, 4), 'overlap')) AS t(k, tag, metric, score, how) ON o_orderkey % 9 = k""")
def concept_resolution(spark, d):
    """Phrases to concepts: by label, tag, metric or shared words; three of them lead nowhere."""
    concepts = table(spark, d, "part").select(F.lit("us-gaap").alias("taxonomy"), F.col("p_type").alias("tag"), F.concat(F.lower("p_type"), F.lit(" goods")).alias("label")).distinct()
    said = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("o_orderkey") % 9).cast("int") + 1)
    return lookup.resolve_concepts(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), said.alias("phrase")), concepts, _KNOWN)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS fiscal_end FROM orders WHERE o_custkey % 50 = 7")
def company_periods(spark, d):
    years = table(spark, d, "orders").select(F.concat(F.lit("C"), _s(F.col("o_custkey") % 50)).alias("ticker"), F.col("o_orderdate").cast("date").alias("fiscal_end"))
    return lookup.periods(years, "c7")


@query("""WITH c AS (SELECT l_orderkey AS qid, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS idx, l_linenumber % 3 > 0 AS t, l_partkey, l_suppkey, l_partkey % 100 AS s FROM lineitem),
r AS (SELECT qid, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN t THEN -s END NULLS LAST, idx) AS INTEGER) AS idx FROM c) SELECT * FROM r WHERE idx <= 3""")
def rerank_evidence(spark, d):
    """Text evidence by a scorer, other evidence behind it in its order, the best three."""
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("idx"), F.when(F.col("l_linenumber") % 3 > 0, "text").otherwise("fact").alias("kind"), F.lit(0.0).alias("score"), "l_partkey", "l_suppkey")
    return answer.rerank_node(c, (F.col("l_partkey") % 100).cast("double"), 3).select("qid", "l_partkey", "l_suppkey", "idx")


@query("""SELECT o_orderkey AS qid, CAST(n AS INTEGER) AS sno, CASE n WHEN 0 THEN 'Sales were ' || CAST(o_custkey + 10 AS VARCHAR) || ' [1].' ELSE 'Again ' || CAST(o_custkey + 10 AS VARCHAR) || ' and ' || CAST(o_custkey + 20 AS VARCHAR) || '.' END AS sentence,
  CAST(o_custkey + w AS VARCHAR) AS text, CASE WHEN w = 10 THEN 'supported' ELSE 'unsupported' END AS status FROM orders JOIN (VALUES (0, 10), (1, 10), (1, 20)) AS t(n, w) ON true""")
def claim_parts(spark, d):
    """Each figure of an answer at the sentence that states it, with what the check said of it."""
    v = F.col("o_custkey")
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("Sales were "), _s(v + 10), F.lit(" [1]. Again "), _s(v + 10), F.lit(" and "), _s(v + 20), F.lit(".")).alias("answer"), F.lit("how much?").alias("question"), v)
    e = a.select("qid", F.lit("fact").alias("kind"), (F.col("o_custkey") + 10).cast("double").alias("value"), F.lit("").alias("body"), F.lit(None).cast("string").alias("period_end"))
    n = verify.check_numbers(a, e, 1e-9).withColumn("status", F.when(F.col("how").isin("digits", "scaled"), "supported").otherwise("unsupported"))
    return verify.decompose(a, n).select("qid", "sno", "sentence", "text", "status")


@query("SELECT 'I.' || CAST(o_custkey % 6 AS VARCHAR) AS item_key, o_orderstatus AS form, count(*) AS n FROM orders GROUP BY ALL")
def item_histogram(spark, d):
    rows = table(spark, d, "orders").select(T.item_key(F.lit("I"), _s(F.col("o_custkey") % 6)).alias("item_key"), F.col("o_orderstatus").alias("form"))
    return facts.histogram(rows, "item_key", "form")


_NAMES = ("Zentra", "Morvex", "Quillon", "Bantrel", "Ostrava")
_FIRMS = "fi AS (SELECT CAST(l_orderkey AS VARCHAR) AS accn, ['Zentra', 'Morvex', 'Quillon', 'Bantrel', 'Ostrava'][l_suppkey % 5 + 1] AS a, ['Zentra', 'Morvex', 'Quillon', 'Bantrel', 'Ostrava'][l_partkey % 5 + 1] AS b, l_returnflag AS f, l_linenumber AS line FROM lineitem)"


def _firms(spark, d):
    """Sentences of filings that name two firms of five and how they stand."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linenumber")
    a, b = (F.element_at(F.array(*map(F.lit, _NAMES)), (F.col(c) % 5).cast("int") + 1) for c in ("l_suppkey", "l_partkey"))
    verb = F.when(F.col("l_returnflag") == "A", " completed its acquisition of ").when(F.col("l_returnflag") == "N", " relies on wafers supplied by ").otherwise(" competes directly with ")
    text = F.concat(F.lit("During the fiscal period "), a, F.lit(" Corp"), verb, b, F.lit(" Holdings Inc in several markets."))
    return li.select(_s("l_orderkey").alias("accn"), text.alias("text"), (F.col("l_linenumber") * 1000).cast("int").alias("char_start"))


@query(f"WITH {_FIRMS}, n AS (SELECT accn, unnest([a, b]) AS name FROM fi) SELECT lower(name) AS key, name, count(DISTINCT accn) AS n_filings FROM n GROUP BY name HAVING count(DISTINCT accn) >= 2")
def organisations(spark, d):
    return relations.discover(_firms(spark, d))


@query(f"""WITH {_FIRMS}, o AS (SELECT DISTINCT lower(name) AS alias FROM (SELECT unnest([a, b]) AS name FROM fi)),
g AS (SELECT alias, alias AS node, 'organization' AS kind FROM o WHERE alias <> 'zentra' UNION ALL SELECT * FROM (VALUES ('zentra', 'zentra', 'company'), ('zen', 'zentra', 'company'), ('abcdef ghi', 'abcdef ghi', 'company'), ('abcdef', 'abcdef ghi', 'company'), ('abc', 'abcdef ghi', 'company'))
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{a}', '{n.lower()}', 'agency')" for a, n in relations.AGENCIES.items())}))
SELECT * FROM g""")
def gazetteer_rows(spark, d):
    """Names found, agencies and issuers, the later ones over the earlier."""
    issuers = spark.createDataFrame([("Zentra Systems Inc", "ZEN"), ("The Abcdef Ghi Corp.", "ABC")], "name string, ticker string")
    return relations.gazetteer(relations.discover(_firms(spark, d)), issuers)


@query(f"""WITH {_FIRMS}, e AS (SELECT accn, lower(a) AS a, lower(b) AS b, CASE f WHEN 'A' THEN 'acquired' WHEN 'N' THEN 'supplies' ELSE 'competes_with' END AS kind, line FROM fi WHERE a <> b),
s AS (SELECT accn, kind, line, CASE WHEN kind = 'supplies' THEN b WHEN kind = 'competes_with' THEN least(a, b) ELSE a END AS source, CASE WHEN kind = 'supplies' THEN a WHEN kind = 'competes_with' THEN greatest(a, b) ELSE b END AS target FROM e)
SELECT DISTINCT source, target, kind, accn, CAST(line * 1000 AS INTEGER) AS char_start FROM s""")
def relation_edges(spark, d):
    """Sentences, mentions, cues and edges: what is acquired, supplied by ('by' turns an edge round) or competes (either way round)."""
    chunks = _firms(spark, d)
    gaz = relations.gazetteer(relations.discover(chunks), spark.createDataFrame([("Zentra Systems Inc", "ZEN")], "name string, ticker string"))
    return relations.distinct_edges(relations.extract(chunks, gaz, "accn", "char_start")).select("source", "target", "kind", "accn", "char_start")
