"""Benchmark decontamination: a broadcast hash set of test n-grams, verified on whole texts.

Method: the windows of the benchmark (``window`` consecutive normalised words,
or a shorter item's whole sequence) become a sorted array of 64-bit hashes that
every task holds. A task turns each document into word ids of the benchmark's
own vocabulary, hashes only the stretches in which every word is known, looks
the hashes up and compares each hit word by word. Documents are never shuffled.

The broadcast is bounded by ``max_block_bytes`` of benchmark text. A larger
benchmark is cut into blocks of that size by a hash of the item; each block's
index is made, scanned against all documents, written and let go before the next
one's, and the hits are merged, so nothing is left out and one block is held at a
time.

Defined results: null text has no words; a document without words is clean; a
null ``item_id`` still removes words but is neither counted nor listed; windows
that several items share count for each; repeated rows each give a row; texts of
any length are scanned whole; an empty benchmark leaves all documents clean, and
no documents give no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import materialise, pick, slices

WINDOW = 10
MAX_BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z; ASCII other than 0-9 and a-z separates; bytes of non-ASCII characters stay.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)

SCAN = "doc_id long, text_key long, n_words long, spans array<struct<start:long,stop:long>>, item_ids array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _roll(ids: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h ^ (ids[at + j].astype(np.uint64) + np.uint64(seed))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def build_index(items: list[tuple], window: int) -> dict:
    """Vocabulary and, for each window length, hashes (sorted), windows and their items."""
    vocab: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
        k = min(window, len(ids))
        for p in range(len(ids) - k + 1 if k else 0):
            found[k][tuple(ids[p : p + k])].add(item)
    sizes = {}
    for k, of in found.items():
        grid = np.array(list(of), np.int32).reshape(len(of), k)
        owners = [sorted(x for x in v if x is not None) for v in of.values()]
        seed = 1
        while True:  # a seed under which no two windows share a hash
            h = _roll(grid.ravel(), np.arange(len(grid)) * k, k, seed)
            if len(np.unique(h)) == len(h):
                break
            seed += 1
        order = np.argsort(h)
        sizes[k] = (seed, h[order], grid[order], [owners[i] for i in order])
    return {"vocab": vocab, "sizes": sizes}


def _matches(ids: np.ndarray, ends: np.ndarray, index: dict):
    """(start, k, owners) of every verified occurrence, over the documents laid end to end."""
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    for k, (seed, hashes, grid, owners) in index["sizes"].items():
        n = len(ids) - k + 1
        if n <= 0:
            continue
        at = np.flatnonzero(known[k:] - known[:n] == k)
        at = at[ends[at] == ends[at + k - 1]]
        if not len(at):
            continue
        h = _roll(ids, at, k, seed)
        where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[where] == h
        at, where = at[hit], where[hit]
        same = (ids[at[:, None] + np.arange(k)] == grid[where]).all(1)
        yield k, at[same], where[same], owners


def _scan(index):
    def run(batches):
        held = index.value
        get = held["vocab"].get
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            rows = [[get(w, 0) for w in words(t)] for t in texts]
            counts = np.array([len(r) for r in rows], np.int64)
            firsts = np.concatenate(([0], np.cumsum(counts)))
            ids = np.fromiter((x for r in rows for x in r), np.int32, int(firsts[-1]))
            ends = np.repeat(np.arange(len(rows)), counts)
            spans: dict[int, list] = defaultdict(list)
            named: dict[int, set] = defaultdict(set)
            with np.errstate(over="ignore"):
                for k, at, where, owners in _matches(ids, ends, held):
                    for p, w in zip(at.tolist(), where.tolist(), strict=True):
                        d = int(ends[p])
                        spans[d].append((p - int(firsts[d]), p - int(firsts[d]) + k))
                        named[d].update(owners[w])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_key"), pa.array(counts),
                    pa.array([[{"start": s, "stop": e} for s, e in _merge(spans.get(i, []))] for i in range(len(rows))], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([sorted(named.get(i, [])) for i in range(len(rows))], pa.list_(pa.string())),
                ],
                names=["doc_id", "text_key", "n_words", "spans", "item_ids"],
            )

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _indexes(items: DataFrame, window: int, max_block_bytes: int) -> Iterator[tuple]:
    """(index, whether it is the only one), broadcast one after the other, of at most ``max_block_bytes`` of text (or one item) each."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("string"), "text").filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_block_bytes))
    for i in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)
        index = spark.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in part.toLocalIterator()], window))
        yield index, blocks == 1
        if blocks > 1:
            index.destroy()  # what it found is written


def occurrences(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window=WINDOW, max_block_bytes=MAX_BLOCK_BYTES) -> DataFrame:
    """Per document row: ``n_words``, the merged word ``spans`` that any benchmark window covers, and the ``item_ids``."""
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    every = None
    for index, alone in _indexes(pick(items, item_id=item_col, text=item_text), window, max_block_bytes):
        found = docs.mapInArrow(_scan(index), SCAN)
        if alone:
            return found
        # the first block names all rows, the others those they hit
        found = materialise(found.filter(F.lit(every is None) | (F.size("spans") > 0)).withColumn("named", F.lit(int(every is None))), "hits")
        every = found if every is None else every.unionByName(found)
    merged = every.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.sum("named").cast("int").alias("copies"),
    )  # a row that is there several times is hit as often
    return merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "text_key", "n_words", _join_spans("spans").alias("spans"), "item_ids")


def _join_spans(spans: str):
    """Sorted spans with those that touch or overlap made one."""
    return F.expr(
        f"aggregate({spans}, cast(array() as array<struct<start:bigint,stop:bigint>>), (a, s) -> "
        "case when size(a) > 0 and s.start <= element_at(a, -1).stop "
        "then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).stop, s.stop) as stop))) "
        "else concat(a, array(s)) end)"
    )


def report(hits: DataFrame) -> DataFrame:
    """The digest of ``occurrences``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _clean_only(index, text):
    def run(batches):
        held = index.value
        get = held["vocab"].get
        for b in slices(batches, text):
            rows = [[get(w, 0) for w in words(t)] for t in b.column(text).to_pylist()]
            counts = np.array([len(r) for r in rows], np.int64)
            ids = np.fromiter((x for r in rows for x in r), np.int32, int(counts.sum()))
            ends = np.repeat(np.arange(len(rows)), counts)
            clean = np.ones(len(rows), bool)
            with np.errstate(over="ignore"):
                for _, at, _, _ in _matches(ids, ends, held):
                    clean[ends[at]] = False
            yield b.filter(pa.array(clean))

    return run


def remove_documents(docs: DataFrame, items: DataFrame, *, text_col="text", item_col="item_id", item_text="text", window=WINDOW, max_block_bytes=MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a benchmark window; one filter for each block of the benchmark."""
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    kept = flat
    for index, alone in _indexes(pick(items, item_id=item_col, text=item_text), window, max_block_bytes):
        kept = kept.mapInArrow(_clean_only(index, f"_c{docs.columns.index(text_col)}"), flat.schema)
        if not alone:
            kept = materialise(kept, "clean")
    return kept.toDF(*docs.columns)


def _cut(batches):
    for b in slices(batches):
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if not text or not spans:
                out.append(text)
                continue
            raw = text.encode()
            flat = raw.translate(_TABLE)
            bounds, at = [], 0
            for w in flat.split():
                at = flat.index(w, at)
                bounds.append((at, at + len(w)))
                at += len(w)
            keep, last = [], 0
            for s in spans:
                keep.append(raw[last : bounds[s["start"]][0]])
                last = bounds[s["stop"] - 1][1]
            out.append(b"".join([*keep, raw[last:]]).decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove_spans(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """doc_id and text, without the words of any benchmark window (what stands between them stays)."""
    hits = occurrences(docs, items, id_col=id_col, text_col=text_col, **how).select("doc_id", "text_key", "spans").distinct()
    keyed = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    h = hits.select(F.col("doc_id").alias("_d"), "text_key", "spans")
    both = keyed.join(h, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("text_key")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string")
