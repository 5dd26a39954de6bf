"""The registered queries on the driver's smallest tables: against their SQL, or against brute force."""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evidencelake.llm import registry, tokens

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, duck, tiny, tmp_path, name):
    out = str(tmp_path / name)
    registry.QUERIES[name](spark, tiny).write.parquet(out)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {registry.ORACLE[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE g AS SELECT * FROM '{out}/*.parquet'")
    types = [dict(duck.execute(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall()) for t in "og"]
    assert types[0] == types[1]
    cols = ", ".join(f'"{c}"' for c in sorted(types[0]))
    for a, b in ("og", "go"):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchone() == (0,)


def rows(duck, sql):
    return duck.execute(sql).fetchall()


def test_quality(spark, duck, tiny):
    got = registry.op1_quality_votes(spark, tiny).collect()
    ids = [i for (i,) in rows(duck, "SELECT doc_id FROM documents")]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(rows(duck, "SELECT doc_id, quality FROM labels"))
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) >= 0.95


def test_token_counts_and_packing(spark, duck, tiny):
    t = tokens.WordIds().tokenizer
    texts = rows(duck, "SELECT doc_id, text FROM documents")
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts}
    assert {r.doc_id: r.n_tokens for r in registry.op5_token_counts(spark, tiny).collect()} == {d: len(x) for d, x in ids.items()}
    got = registry.op6_pack(spark, tiny).collect()
    expect = {}
    for d, x in ids.items():
        x = [*x, 0]
        for i, at in enumerate(range(0, len(x), 2048)):
            p = x[at : at + 2048]
            expect[d, i] = (at, len(p), zlib.crc32(array("I", p).tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expect
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(n for _, n, _ in expect.values()) // 2048) * 1.01 + 1


def test_pages(spark, duck, tiny):
    got = {r.page_id: (r.text, r.n_chars) for r in registry.op7_template_slots(spark, tiny).collect()}
    for i, page in rows(duck, "SELECT page_id, html FROM pages"):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(p for p in parts if p)
        assert got[i] == (text, len(text))


def test_shards(spark, duck, tiny):
    got = registry.op8_ring_shards(spark, tiny).collect()
    expect = Counter((d, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for d, x in rows(duck, "SELECT doc_id, text FROM documents"))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expect
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, i) for s, k in n.items() for i in range(k)}
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_neighbours(spark, duck, tiny):
    data = rows(duck, "SELECT vec_id, embedding FROM embeddings")
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    got = defaultdict(list)
    for r in registry.op10_kmeans_tree(spark, tiny).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    share = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != i][:10]
        mine = got[ids[i]]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, v, s in mine)
        share.append(len({v for _, v, _ in mine} & set(ids[best])) / 10)
    assert np.mean(share) >= 0.9
