"""The pipeline's stages on the small tables, each against what it promises."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
from test_operators import brute_contamination, brute_groups, check_packing

from evidencelake.llm import quality, registry, tokens


def test_registry_names_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").cache()
    columns, seen = docs.dtypes, [docs.count()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}

    good = steps["quality"](spark, docs, tiny).cache()
    kept = {r.doc_id for r in good.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())

    unique = steps["near_dedup"](spark, good, tiny).cache()
    assert len({r.text for r in unique.collect()}) == unique.count()

    cut = steps["substring_dedup"](spark, unique, tiny).cache()
    windows = Counter()
    for r in cut.collect():
        w = r.text.split()
        windows.update({tuple(w[p : p + 50]) for p in range(len(w) - 49)})
    assert max(windows.values(), default=1) == 1

    clean = steps["decontaminate"](spark, cut, tiny).cache()
    packed = steps["pack"](spark, clean, tiny).collect()
    for df in (good, unique, cut, clean):
        assert df.dtypes == columns
        seen.append(df.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[-1]
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def plain_stages(docs, model, benchmark):
    """The pipeline's rows (doc_id, text) before packing, by brute force."""
    terms = quality.Terms()
    got = [terms(t) for _, t in docs]
    scores = [model.prior if not len(g[0]) else float(model.score(model.embed([g]), block=100)[0]) for g in got]
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0.3]
    kept = {i for i, _, component, _ in brute_groups(docs) if i is None or i == component}
    docs = [d for d in docs if d[0] in kept]
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    dirty = {i for i, *_, hit in brute_contamination(out, benchmark) if hit}
    return [d for d in out if d[0] not in dirty]


def test_run_matches_brute_force(spark, tiny):
    read = lambda name: spark.read.parquet(f"{tiny}/{name}.parquet")
    model = quality.fit(read("documents"), read("labels"))
    benchmark = [(r.item_id, r.text) for r in read("benchmark").collect()]
    left = plain_stages([(r.doc_id, r.text) for r in read("documents").collect()], model, benchmark)
    assert 0 < len(left) < read("documents").count()
    t = tokens.WordIds().tokenizer
    expect = Counter()
    for i, x in left:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expect[i, n, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    total = sum(k[3] for k in expect)
    assert check_packing(rows, 2048) <= -(-total // 2048) + 1


def test_empty_and_odd_documents(spark, tiny, tmp_path):
    """Nulls, empties, repeated rows and columns that clash pass every stage; so does an empty table."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    from pyspark.sql import functions as F

    odd = docs.limit(20).unionByName(docs.limit(5)).withColumn("text", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, " ").otherwise(F.col("text"))).withColumn("_kept", F.lit(1)).withColumn("a.b", F.lit("x"))
    for frame in (odd, odd.limit(0)):
        held = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, tiny)
            assert held.dtypes == odd.dtypes, name
            held.write.parquet(str(tmp_path / f"{name}{frame is odd}"))
            held = spark.read.parquet(str(tmp_path / f"{name}{frame is odd}"))
        packed = corpus_pipeline.STAGES[-1][1](spark, held, tiny)
        assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()
    assert packed.count() == 0
