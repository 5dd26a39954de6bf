"""Queries over documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import ids
from evidencelake.functions import numbers as N
from evidencelake.operators import chunking, evals, locate, relations, search
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


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query("""SELECT doc_id, 'FULL' AS item, CAST(s AS INTEGER) AS char_start, CAST(least(s + 2048, length(text)) AS INTEGER) AS char_end, substr(text, s + 1, 2048) AS text
FROM (SELECT doc_id, text, unnest(range(0, length(text), 2048)) AS s FROM documents)""")  # fmt: skip
def naive_chunks(spark, d):
    return chunking.naive_chunks(_docs(spark, d), "doc_id").drop("chunk_id")


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{ids.CHUNK_NAMESPACE.replace("-", "")}') || encode(CAST(doc_id AS VARCHAR) || ':0:' || CAST(length(text) AS VARCHAR))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""")  # fmt: skip
def chunk_ids_uuid5(spark, d):
    return _docs(spark, d).select("doc_id", ids.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.length("text")).alias("chunk_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
a AS (SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS idx, CAST(start AS INTEGER) AS start, CAST(start + length(block) AS INTEGER) AS "end", block FROM a WHERE length(block) > 0""")  # fmt: skip
def block_runs(spark, d):
    return chunking.line_blocks(_docs(spark, d))


def _flat(spark, d):
    p = table(spark, d, "pages").select("page_id", "html").withColumn("f", chunking.flatten("html"))
    return p.select("page_id", F.lit("10-K").alias("form"), "f.text", "f.blocks")


_BLOCK = "|".join(sorted(chunking.BLOCK_TAGS))
_FLAT = rf"""a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>|<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)</?({_BLOCK})(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
fl AS (SELECT page_id, [y FOR y IN [trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split(t, chr(10))] IF y <> ''] AS ls FROM c)"""


@query(f"WITH {_FLAT} SELECT page_id, array_to_string(ls, chr(10)) || CASE WHEN len(ls) > 0 THEN chr(10) ELSE '' END AS text, CAST(len(ls) AS INTEGER) AS n_blocks FROM fl")
def html_flatten(spark, d):
    return _flat(spark, d).select("page_id", "text", F.size("blocks").alias("n_blocks"))


@query(f"""WITH {_FLAT}, n AS (SELECT page_id, CAST(length(array_to_string(ls, chr(10))) + CASE WHEN len(ls) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_chars FROM fl)
SELECT page_id, '10-K' AS form, n_chars, CASE WHEN n_chars < 20000 THEN 'quarantined' ELSE 'degraded' END AS status, 'no Item heading in the body' AS reason FROM n""")
def section_outcomes(spark, d):
    flat = _flat(spark, d)
    return chunking.outcomes(flat, chunking.sections(chunking.headings(chunking.block_rows(flat, "page_id"), "page_id"), "page_id"), "page_id")


_ITEMS = (("1", "Business"), ("1A", "Risk Factors"), ("7", "Discussion"), ("8", "Statements"))
_ITEM_ROWS = ", ".join(f"({i}, '{item}', 'Item {item}. {title}', '{title}')" for i, (item, title) in enumerate(_ITEMS))


def _filed(spark, d):
    """Filed pages made for each document: a contents table before, after or not at all, one or three blocks an item, or no items."""
    k, n = F.col("doc_id") % 4, (1000 + F.col("doc_id") % 7 * 100).cast("int")
    p = lambda *x: F.concat(F.lit("<p>"), *x, F.lit("</p>"))
    body = F.when(k == 2, F.concat(*[p(F.repeat(F.lit(c), F.lit(700))) for c in "abc"])).otherwise(p(F.repeat(F.lit("y"), n)))
    toc = F.concat(*[p(F.lit(f"Item {i}. {t}")) for i, t in _ITEMS])
    items = F.concat(*[F.concat(F.lit(f"<h2>Item <b>{i}.</b>\n {t}</h2>"), body) for i, t in _ITEMS])
    html = F.when(k == 0, F.concat(toc, items)).when(k == 1, F.concat(items, toc)).when(k == 2, items).otherwise(p(F.repeat(F.lit("z"), F.when(F.col("doc_id") % 8 == 3, n * 20).otherwise(n))))
    return table(spark, d, "documents").select("doc_id", chunking.flatten(html).alias("f")).select("doc_id", F.lit("10-K").alias("form"), "f.text", "f.blocks")


_FILED = f"""d AS (SELECT doc_id, doc_id % 4 AS k, 1000 + doc_id % 7 * 100 AS n FROM documents), it AS (SELECT * FROM (VALUES {_ITEM_ROWS}) AS t(i, item, head, title)),
ln AS (SELECT doc_id, k, item, title, 'toc' AS kind, CASE k WHEN 0 THEN i ELSE 1000 + i END AS ord, length(head) AS len FROM d, it WHERE k IN (0, 1)
  UNION ALL SELECT doc_id, k, item, title, 'head', 100 + 10 * i, length(head) FROM d, it WHERE k < 3
  UNION ALL SELECT doc_id, k, item, title, 'body', 100 + 10 * i + b, CASE k WHEN 2 THEN 700 ELSE n END FROM d, it, (SELECT unnest([1, 2, 3]) AS b) WHERE k < 3 AND (k = 2 OR b = 1)
  UNION ALL SELECT doc_id, k, NULL, NULL, 'body', 0, CASE WHEN doc_id % 8 = 3 THEN n * 20 ELSE n END FROM d WHERE k = 3),
ls AS (SELECT *, CAST(coalesce(sum(len + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, CAST(sum(len + 1) OVER (PARTITION BY doc_id) AS INTEGER) AS total FROM ln),
sec AS (SELECT doc_id, item, title, s AS start, CAST(s + len AS INTEGER) AS body, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), total) AS "end" FROM ls WHERE kind = 'head')"""


def _found(spark, d):
    flat = _filed(spark, d)
    return flat, chunking.sections(chunking.headings(chunking.block_rows(flat, "doc_id"), "doc_id"), "doc_id")


@query(f"WITH {_FILED} SELECT doc_id, item, title, start, body, \"end\" FROM sec")
def item_sections(spark, d):
    """Items of filed pages, without those of contents tables."""
    return _found(spark, d)[1].select("doc_id", "item", "title", "start", "body", "end")


@query(f"""WITH {_FILED} SELECT DISTINCT doc_id, CASE WHEN k < 3 THEN 'split' WHEN total < 20000 THEN 'quarantined' ELSE 'degraded' END AS status, CASE WHEN k = 3 THEN 'no Item heading in the body' END AS reason FROM ls""")
def item_outcomes(spark, d):
    flat, found = _found(spark, d)
    return chunking.outcomes(flat, found, "doc_id").select("doc_id", "status", "reason")


@query(f"""WITH {_FILED}, b AS (SELECT ls.*, row_number() OVER (PARTITION BY doc_id, item ORDER BY ord) AS nth FROM ls WHERE kind = 'body'),
h AS (SELECT doc_id, item, s FROM ls WHERE kind = 'head')
SELECT doc_id, item, h.s AS char_start, CAST(CASE WHEN k = 1 AND item = '8' THEN total - 1 ELSE b.s + b.len END AS INTEGER) AS char_end FROM h JOIN b USING (doc_id, item) WHERE k < 2 AND nth = 1
UNION ALL SELECT doc_id, item, h.s, CAST(b.s + b.len AS INTEGER) FROM h JOIN b USING (doc_id, item) WHERE k = 2 AND nth = 2
UNION ALL SELECT doc_id, item, s, CAST(s + len AS INTEGER) FROM b WHERE k = 2 AND nth = 3
UNION ALL SELECT doc_id, 'FULL', CAST(x AS INTEGER), CAST(least(x + 1800, total - 1) AS INTEGER) FROM (SELECT doc_id, total, unnest(range(0, total - 1, 1800)) AS x FROM ls WHERE k = 3 AND total >= 20000)""")
def item_chunks(spark, d):
    """Chunks of the sections: a heading with its block, three blocks in two chunks, or an unsplit document in pieces of full length."""
    flat, found = _found(spark, d)
    return chunking.chunks(flat, chunking.usable_sections(found, chunking.outcomes(flat, found, "doc_id"), "doc_id"), "doc_id").select("doc_id", "item", "char_start", "char_end")


def _chunks(spark, d):
    flat = _flat(spark, d)
    whole = flat.select("page_id", F.lit("").alias("part"), F.lit("FULL").alias("item"), F.lit("10-K").alias("title"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return flat, chunking.chunks(flat, whole, "page_id")


@query()
def section_chunks(spark, d):
    return _chunks(spark, d)[1]


@query("SELECT doc_id, CAST(s AS INTEGER) AS char_start FROM (SELECT doc_id, unnest(range(0, length(text), 2048)) AS s FROM documents WHERE doc_id % 9 = 0)")
def chunk_slice_audit(spark, d):
    """Chunks held against their documents, of which one in nine has changed since."""
    docs = _docs(spark, d)
    cut = chunking.naive_chunks(docs, "doc_id")
    # every character becomes another, whatever it was, and lengths stay
    other = F.array_join(F.transform(F.split("text", "b", -1), lambda x: F.repeat(F.lit("b"), F.length(x))), "_")
    now = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, other).otherwise(F.col("text")))
    return chunking.audit(cut, now, "doc_id").select("doc_id", "char_start")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE NOT (doc_id % 3 = 0 AND lang = 'en')")
def incremental_rebuild(spark, d):
    m = _docs(spark, d).select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    done = m.select("doc_id", F.col("sha256").alias("source_sha256"), F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") == "en"), chunking.CHUNKER).otherwise("v0").alias("chunker"))
    return chunking.stale(m.select("doc_id", "sha256"), done, "doc_id")


_GOLD = "gold AS (SELECT item_id AS qid, doc_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS s, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS e FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, d):
    """Benchmark passages found in documents."""
    return locate.passages(_docs(spark, d), _questions(spark, d))


@query(f"WITH {_GOLD} SELECT * FROM gold")
def gold_spans(spark, d):
    return _gold(spark, d)


_BM25 = """pp AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
pt AS (SELECT id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM pp) GROUP BY id, len(ws), term),
st AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM pp), dfs AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
sc AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM qt JOIN pt USING (term) JOIN dfs USING (term) CROSS JOIN st GROUP BY qid, id),
sp AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM sc)"""


def _bm25(spark, d, k=10):
    return search.bm25(_docs(spark, d), _questions(spark, d), k=k, digits=9)


@query(f"WITH {_BM25} SELECT qid, id, rank FROM sp WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("qid", "id", "rank")


_DENSE = """qv AS (SELECT vec_id // 50 AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT qid, vec_id AS id, label, list_dot_product(CAST(embedding AS DOUBLE[]), qv) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv, qv))) AS score FROM embeddings CROSS JOIN qv)"""


def _vectors(spark, d):
    """All vectors; and as stated queries those whose id divides by 50, numbered in that order."""
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("qid"), F.col("embedding").alias("vector"))


def _dense(spark, d, k, where=None):
    e, q = _vectors(spark, d)
    return search.dense(e, q, k=k, where=where, digits=9)


@query(f"WITH {_DENSE}, r AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM ds) SELECT * FROM r WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).select("qid", "id", "rank")


@query(f"WITH {_DENSE}, r AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM ds WHERE label IN (1, 2, 3)) SELECT * FROM r WHERE rank <= 5")
def dense_topk_filtered(spark, d):
    return _dense(spark, d, 5, {"label": [1, 2, 3]}).select("qid", "id", "rank")


_RRF = f"""{_BM25}, {_DENSE}, dr AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM ds),
runs AS (SELECT qid, id, rank, 'sparse' AS r FROM sp WHERE rank <= 50 UNION ALL SELECT qid, id, rank, 'dense' AS r FROM dr WHERE rank <= 50),
fu AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, max(CASE WHEN r = 'sparse' THEN rank END) AS sparse_rank, max(CASE WHEN r = 'dense' THEN rank END) AS dense_rank FROM runs GROUP BY qid, id),
rr AS (SELECT qid, id, sparse_rank, dense_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM fu)"""


def _rrf(spark, d, limit=50):
    return search.rrf({"sparse": _bm25(spark, d, 50), "dense": _dense(spark, d, 50)}, limit=limit, digits=12)


@query(f"WITH {_RRF} SELECT * FROM rr WHERE rank <= 50")
def rrf_fuse(spark, d):
    return _rrf(spark, d).select("qid", "id", F.element_at("ranks", "sparse").alias("sparse_rank"), F.element_at("ranks", "dense").alias("dense_rank"), "rank")


_HYBRID = f"""{_RRF}, hy AS (SELECT rr.qid, rr.id, rr.rank AS fused_rank, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))) AS s
  FROM rr JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = rr.id WHERE rank <= 50),
hr AS (SELECT qid, id, fused_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, fused_rank, id) AS INTEGER) AS rank FROM hy)"""


def _hybrid(spark, d, n=5):
    hits = search.hydrate(_rrf(spark, d), _docs(spark, d).select("doc_id", "text"), "doc_id")
    return search.rerank(hits, _questions(spark, d), n)


@query(f"WITH {_HYBRID} SELECT * FROM hr WHERE rank <= 5")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("qid", "id", "fused_rank", "rank")


def _scored(spark, d, k=50):
    """Questions with gold, ranked documents and their overlaps."""
    gold = _gold(spark, d).select("qid", F.col("doc_id").cast("string").alias("accn"), "s", "e")
    from pyspark.sql import Window

    gold = gold.withColumn("span", F.row_number().over(Window.partitionBy("qid").orderBy("accn")))
    ranked = _bm25(spark, d, k).select("qid", "rank", F.col("id").cast("string").alias("accn"), F.lit(0).alias("char_start"), F.lit(1 << 30).alias("char_end"))
    q = _questions(spark, d).select("qid", F.when(F.col("qid") % 2 == 0, "numeric").otherwise("narrative").alias("slice"))
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n_spans"))
    return q.join(n, "qid"), ranked, gold, search.overlaps(ranked, gold)


_SCORED = f"""{_BM25}, {_GOLD}, q AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'numeric' ELSE 'narrative' END AS slice, count(*) AS n_spans FROM gold GROUP BY qid),
ov AS (SELECT sp.qid, rank FROM sp JOIN gold ON gold.qid = sp.qid AND gold.doc_id = sp.id WHERE rank <= 50)"""


@query(f"""WITH {_SCORED}, ks AS (SELECT unnest([1, 5, 10]) AS k), p AS (SELECT q.qid, slice, k, n_spans, CASE WHEN count(rank) FILTER (WHERE rank <= k) > 0 THEN 1.0 ELSE 0.0 END AS hit, count(rank) FILTER (WHERE rank <= k) / n_spans AS recall,
  coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE rank <= k), 0) / list_sum([1.0 / log2(i + 1.0) FOR i IN range(1, least(n_spans, k) + 1)]) AS ndcg
  FROM q CROSS JOIN ks LEFT JOIN ov ON ov.qid = q.qid GROUP BY q.qid, slice, k, n_spans)
SELECT CASE WHEN grouping(slice) = 1 THEN 'overall' ELSE slice END AS slice, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(hit), 9) AS hit_rate, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg FROM p GROUP BY GROUPING SETS ((slice, k), (k))""")  # fmt: skip
def retrieval_metrics(spark, d):
    q, _, _, over = _scored(spark, d)
    out = evals.slice_means(evals.retrieval_scores(q, over), q)
    return out.withColumns({c: F.round(c, 9) for c in ("hit_rate", "recall", "ndcg")})


_RATE = ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 9) AS hit_at_{k}" for k in evals.DEPTHS)


@query(f"""WITH {_SCORED}, f AS (SELECT qid, min(rank) AS r FROM ov GROUP BY qid), j AS (SELECT q.qid, slice, r FROM q LEFT JOIN f USING (qid))
SELECT slice, count(*) AS n, count(r) AS found, median(r) AS median_rank, {_RATE}, count(r) AS filing_found, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 9) AS filing_hit_at_10, median(r) AS filing_median_rank FROM j GROUP BY slice""")  # fmt: skip
def retrieval_depth(spark, d):
    q, ranked, gold, over = _scored(spark, d)
    out = evals.depth_curve(q, ranked, over, gold)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if "hit_at" in c})


@query(f"""WITH {_HYBRID}, {_GOLD}, g AS (SELECT DISTINCT qid, doc_id AS id FROM gold), n AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
a AS (SELECT n.qid, n, (SELECT count(*) FROM rr JOIN g USING (qid, id) WHERE rr.qid = n.qid AND rank <= 50) AS deep, (SELECT count(*) FROM rr JOIN g USING (qid, id) WHERE rr.qid = n.qid AND rank <= 5) AS before,
  (SELECT count(*) FROM hr JOIN g USING (qid, id) WHERE hr.qid = n.qid AND rank <= 5) AS after FROM n)
SELECT count(*) AS n, round(avg(deep / n), 9) AS recall_deep, round(avg(before / 5), 9) AS precision_fused, round(avg(after / 5), 9) AS precision_reranked, round(avg(after / 5) - avg(before / 5), 9) AS delta FROM a""")  # fmt: skip
def precision_delta(spark, d):
    gold = _gold(spark, d).select("qid", F.col("doc_id").alias("id")).distinct()
    out = evals.precision_delta(_rrf(spark, d), _hybrid(spark, d), gold)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "n"})


@query("""WITH v AS (SELECT doc_id, text, CAST(doc_id * 7 + 1234 AS BIGINT) AS x FROM documents)
SELECT doc_id, contains(text, CAST(x AS VARCHAR)) OR contains(text, format('{:,}', x)) OR (x >= 1000 AND (contains(text, CAST(x // 1000 AS VARCHAR)) OR contains(text, format('{:,}', x // 1000))
  OR contains(text, CAST(CAST(round_even(x / 1000.0, 0) AS BIGINT) AS VARCHAR)) OR contains(text, format('{:,}', CAST(round_even(x / 1000.0, 0) AS BIGINT))))) OR (x >= 1000000 AND (contains(text, CAST(x // 1000000 AS VARCHAR)) OR contains(text, CAST(CAST(round_even(x / 1000000.0, 0) AS BIGINT) AS VARCHAR)))) AS found FROM v""")  # fmt: skip
def verify_in_document(spark, d):
    """Whether any way a filing might print a value occurs in its document."""
    v = _docs(spark, d).withColumn("r", N.renderings((F.col("doc_id") * 7 + 1234).cast("double")))
    return v.select("doc_id", F.exists("r", lambda x: F.contains(F.col("text"), x)).alias("found"))


_ABBR = "|".join(sorted(relations.ABBREVIATIONS)).replace(".", "\\.")


@query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])([\s"'')\]])', '\1' || chr(1) || '\2', 'g'), '(\n+)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
f AS (SELECT *, regexp_matches(piece, '(?i)(^|[^a-z.])\.*({_ABBR})\.+$') OR regexp_matches(piece, '(^|[^\p{{L}}])\p{{Lu}}[.!?]$') AS goes_on FROM x),
g AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM f),
s AS (SELECT doc_id, nth, min(low) AS low, string_agg(piece, '' ORDER BY i) AS raw FROM g GROUP BY doc_id, nth),
t AS (SELECT doc_id, low + length(regexp_extract(raw, '^\s*')) AS a, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS sentence FROM s)
SELECT doc_id, CAST(a AS INTEGER) AS s_start, CAST(a + length(sentence) AS INTEGER) AS s_end, sentence FROM t WHERE sentence <> ''""")
def sentence_spans(spark, d):
    return relations.sentences(_docs(spark, d), "doc_id").select("doc_id", "s_start", "s_end", "sentence")


_EDGES = """ed AS (SELECT 'customer ' || CAST(o_custkey % 40 AS VARCHAR) AS source, 'supplier ' || CAST(l_suppkey % 30 AS VARCHAR) AS target, CASE l_returnflag WHEN 'A' THEN 'acquired' WHEN 'N' THEN 'supplies' ELSE 'competes_with' END AS kind,
  'C' || CAST(o_custkey % 40 AS VARCHAR) AS ticker, CAST(l_orderkey AS VARCHAR) AS accn, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_end, CAST(min(l_linenumber) AS INTEGER) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _edges(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    s = lambda c: c.cast("string")
    kind = F.when(F.col("l_returnflag") == "A", "acquired").when(F.col("l_returnflag") == "N", "supplies").otherwise("competes_with")
    e = j.select(
        F.concat(F.lit("customer "), s(F.col("o_custkey") % 40)).alias("source"), F.concat(F.lit("supplier "), s(F.col("l_suppkey") % 30)).alias("target"), kind.alias("kind"),
        F.concat(F.lit("C"), s(F.col("o_custkey") % 40)).alias("ticker"), s(F.col("l_orderkey")).alias("accn"), s(F.col("o_orderdate").cast("date")).alias("period_end"), F.col("l_linenumber").cast("int").alias("line"),
    )
    return e.groupBy("source", "target", "kind", "ticker", "accn", "period_end").agg(F.min("line").alias("line"))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ed UNION ALL SELECT target FROM ed) GROUP BY node")
def edge_degree(spark, d):
    return relations.degrees(_edges(spark, d))


@query(f"""WITH {_EDGES}, b AS (SELECT source AS node, target AS other, 'out' AS direction, kind, period_end, accn FROM ed UNION ALL SELECT target, source, 'in', kind, period_end, accn FROM ed),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY kind DESC, period_end DESC, other, direction, accn) AS INTEGER) AS rank FROM b WHERE node IN (SELECT 'supplier ' || CAST(n_nationkey AS VARCHAR) FROM nation) AND kind IN ('acquired', 'supplies')) SELECT * FROM r WHERE rank <= 20""")  # fmt: skip
def neighbours(spark, d):
    nodes = table(spark, d, "nation").select(F.concat(F.lit("supplier "), F.col("n_nationkey").cast("string")).alias("node"))
    return relations.neighbours(_edges(spark, d), nodes, ["acquired", "supplies"], order=("accn",)).select("node", "other", "direction", "kind", "period_end", "accn", "rank")


@query(f"""WITH {_EDGES}, qs AS (SELECT n_nationkey AS qid, ['customer', CAST(n_nationkey AS VARCHAR), 'supplies', 'c' || CAST(n_nationkey AS VARCHAR)] AS want0, 'C' || CAST(n_nationkey AS VARCHAR) AS tk FROM nation),
qw AS (SELECT qid, tk, [x FOR x IN want0 IF length(x) > 1] AS want FROM qs),
h AS (SELECT *, [x FOR x IN list_distinct(list_concat(regexp_extract_all(lower(source || ' ' || target || ' ' || kind), '[a-z0-9&]+'), [lower(ticker)])) IF length(x) > 1] AS have FROM ed),
s AS (SELECT qid, ed2.*, len(list_intersect(want, have)) / len(want) + CASE WHEN ticker = tk THEN 0.25 ELSE 0 END AS raw FROM qw JOIN h ed2 ON list_has_any(want, have)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, period_end DESC, accn, target, kind) AS INTEGER) AS rank FROM s)
SELECT qid, rank, round(raw, 4) AS score, source, target, kind, accn FROM r WHERE rank <= 5""")  # fmt: skip
def edge_search(spark, d):
    n = F.col("n_nationkey").cast("string")
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("What does the customer "), n, F.lit(" supplies?")).alias("question"), F.concat(F.lit("C"), n).alias("ticker"))
    return relations.search(_edges(spark, d), q, order=("accn", "target", "kind")).select("qid", "rank", "score", "source", "target", "kind", "accn")


# -- rules, citations and places -----------------------------------------


@query("""WITH c AS (SELECT doc_id, text, source, lang FROM documents), q AS (SELECT n_nationkey AS qid, 'the[a-z]' || substr(lower(n_name), 1, 1) AS re, n_nationkey % 20 AS src FROM nation)
SELECT qid, CAST(doc_id AS VARCHAR) AS chunk_id FROM c JOIN q ON source = 'src' || CAST(src AS VARCHAR) AND lang = 'en' AND CAST(doc_id % 9 AS VARCHAR) >= '2' AND regexp_matches(text, re, 'i')""")
def predicate_gold(spark, d):
    n = table(spark, d, "nation")
    none = F.array().cast("array<string>")
    q = n.select(
        F.col("n_nationkey").alias("qid"), F.concat(F.lit("the[a-z]"), F.lower(F.substring("n_name", 1, 1))).alias("must_match"), F.array(F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string"))).alias("tickers"),
        none.alias("items"), F.array(F.lit("EN")).alias("forms"), F.lit("2").alias("period_from"), F.lit("").alias("period_to"),
    )
    c = _docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("ticker"), F.lit("FULL").alias("item_key"), F.col("lang").alias("form"), (F.col("doc_id") % 9).cast("string").alias("period_end"))
    return evals.predicate_gold(q, c)


@query("""WITH o AS (SELECT o_orderkey AS qid, o_orderstatus AS slice, o_orderkey % 50 AS a, o_orderkey % 77 AS b FROM orders), x AS (SELECT qid, slice, a, unnest([a, b]) AS id FROM o),
y AS (SELECT *, id = a OR id = a + 1 AS got, id < 60 AS known, id % 2 = 0 AS gold FROM x) SELECT slice, count(*) AS citations_made, round(avg(CASE WHEN got OR known THEN 1.0 ELSE 0.0 END), 9) AS citations_resolvable, round(avg(CASE WHEN got AND gold THEN 1.0 ELSE 0.0 END), 9) AS citations_supported FROM y GROUP BY slice""")
def citation_scores(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("slice"), (F.col("o_orderkey") % 50).alias("a"), (F.col("o_orderkey") % 77).alias("b"))
    out = o.select("qid", "slice", F.array("a", F.col("a") + 1).alias("retrieved"), F.array("a", "b").alias("citations"))
    known = spark.range(60).select(F.col("id").alias("chunk_id"))
    gold = o.select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(76).cast("long"), F.lit(2).cast("long"))).alias("chunk_id"))
    got = evals.citation_scores(out, known, gold)
    return got.withColumns({c: F.round(c, 9) for c in ("citations_resolvable", "citations_supported")})


@query()
def locate_value(spark, d):
    """Numbers of four digits and more that documents print, found again with their places."""
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("accn"), "text")
    seen = docs.select("accn", F.explode(F.array_distinct(F.transform(N.readings(F.col("text")), lambda r: F.abs(r["face"])))).alias("val")).filter("val >= 1000 and val < 1e12 and val = floor(val)")
    return locate.values(seen, docs).select("accn", "val", "rendering", "n_hits", F.get("hits", F.lit(0))["start"].alias("first_at"))


@query("""SELECT doc_id, CAST(0 AS INTEGER) AS idx, h AS heading, CAST(0 AS INTEGER) AS gold_start, CAST(least(2400, length(h) + 1 + n) AS INTEGER) AS gold_end
FROM (SELECT doc_id, 'Overview of operations, part ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END AS h, 400 + doc_id % 4 * 900 AS n FROM documents)
WHERE n >= 500 AND doc_id % 5 > 0 AND 8 * length(CAST(doc_id AS VARCHAR)) <= length(h)""")
def heading_candidates(spark, d):
    """Headings over passages of several lengths; some end like a sentence, some are mostly figures."""
    k = F.col("doc_id")
    head = F.concat(F.lit("Overview of operations, part "), k.cast("string"), F.when(k % 5 == 0, ".").otherwise(""))
    made = table(spark, d, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.repeat(F.lit("w "), (200 + k % 4 * 450).cast("int"))).alias("text"))
    return locate.heading_candidates(chunking.line_blocks(made), "doc_id")


@query(f"""WITH {_RRF}, c AS (SELECT rr.qid, rr.id, rr.rank AS fused_rank, ds.score FROM rr JOIN ds ON ds.qid = rr.qid AND ds.id = rr.id WHERE rr.rank <= 50),
r AS (SELECT qid, id, fused_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, fused_rank, id) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""")  # fmt: skip
def cosine_rerank(spark, d):
    e, q = _vectors(spark, d)
    return search.cosine_rerank(_rrf(spark, d), e, q, top_n=5, digits=9).select("qid", "id", "fused_rank", "rank")
