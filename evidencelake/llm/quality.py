"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Method: a text becomes counts of terms: its lower-cased words, the shapes of its
words (runs of capitals, small letters, digits and the marks themselves) and one
for words that repeat the word before, hashed into ``WORD_TERMS`` and
``SHAPE_TERMS`` buckets. Words weigh by TF-IDF, shapes by the root of their share
of the text; either part has a fixed length, so neither drowns the other in a
long text. A truncated SVD of labelled rows gives a latent space of ``DIMS``
dimensions. The labelled rows' vectors are broadcast;
a task multiplies a block of documents with blocks of them, so each document
sees the exact cosine to every labelled vector, and takes a vote of the
``NEIGHBOURS`` nearest, each label weighted by its similarity to the power
``SHARPNESS``.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id; what
is broadcast is therefore bounded by SAMPLE, DIMS and the buckets. Scores are of
whole texts, in one pass without a shuffle.

Defined results: a text without words (null, empty) has no neighbours and gets
the sample's share of label 1; without any labelled rows every score is 0.5; of
labelled rows that are equally near at the last place those of the smaller ids
vote, whatever the blocks; repeated rows each get a row; null labels or ids teach
nothing; an id labelled twice counts once, with its smaller label; texts of any
length are read whole; no documents give no rows; columns other than those named
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import pick, slices

SAMPLE, DIMS, NEIGHBOURS, SHARPNESS = 3000, 48, 11, 8
WORD_TERMS, SHAPE_TERMS = 8192, 1024
TERMS = WORD_TERMS + SHAPE_TERMS + 1
REPEAT = TERMS - 1
#: Length of the part of shapes, where that of words is 1; and what repeats weigh among shapes.
SHAPE_WEIGHT, REPEAT_WEIGHT = 1.5, 2.0
THRESHOLD = 0.3
KNOWN = 200_000


def _class(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def shape(word: str) -> str:
    """``Word,`` -> ``Aa,``; runs longer than two are given as two."""
    out = ""
    for c in map(_class, word):
        if not out.endswith(c if c in "Aa0" else c * 2):
            out += c
    return out


class Terms:
    """Distinct terms and weights before IDF of texts; buckets of words seen are kept, up to ``KNOWN``."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def _buckets(self, word: str) -> tuple[int, int]:
        b = (zlib.crc32(word.lower().encode()) % WORD_TERMS, WORD_TERMS + zlib.crc32(shape(word).encode()) % SHAPE_TERMS)
        if len(self.seen) >= KNOWN:
            self.seen.clear()
        self.seen[word] = b
        return b

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        counts = Counter(words)
        get, make = self.seen.get, self._buckets
        pairs = np.array([get(w) or make(w) for w in counts], np.int64)
        n = np.fromiter(counts.values(), np.float64, len(counts))
        total = np.bincount(pairs.ravel(), weights=np.repeat(n, 2), minlength=TERMS)
        total[REPEAT] = sum(map(str.__eq__, words, words[1:]))
        at = np.flatnonzero(total)
        weights = total[at]
        cut = np.searchsorted(at, WORD_TERMS)
        weights[:cut] = 1 + np.log(weights[:cut])
        weights[cut:] = np.sqrt(weights[cut:] / len(words))
        if at[-1] == REPEAT:
            weights[-1] *= REPEAT_WEIGHT
        return at, weights


def _terms_of(batches):
    terms = Terms()
    for b in slices(batches):
        got = [terms(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))],
            names=["label", "terms", "weights"],
        )


class Model:
    """IDF, the latent axes and the labelled vectors."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = DIMS):
        self.labels = np.array([y for y, at, _ in rows if len(at)], np.float64)
        self.prior = float(np.mean([y for y, *_ in rows])) if rows else 0.5
        rows = [r for r in rows if len(r[1])]
        df = np.bincount(np.concatenate([r[1] for r in rows]), minlength=TERMS) if rows else np.zeros(TERMS)
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        a = np.zeros((len(rows), TERMS), np.float32)
        for i, (_, at, w) in enumerate(rows):
            a[i, at] = self._weighted(at, w)
        self.axes = self._axes(a, dims)
        self.vectors = _unit(a @ self.axes)

    def _weighted(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        cut = np.searchsorted(at, WORD_TERMS)
        words, shapes = w[:cut] * self.idf[at[:cut]], w[cut:]
        return np.concatenate([words / (np.linalg.norm(words) or 1), SHAPE_WEIGHT * shapes / (np.linalg.norm(shapes) or 1)]).astype(np.float32)

    @staticmethod
    def _axes(a: np.ndarray, dims: int) -> np.ndarray:
        """Right singular vectors by a randomised SVD with two power rounds."""
        dims = min(dims, *a.shape) if len(a) else 1
        q = a.T @ np.random.default_rng(5).standard_normal((len(a), dims + 8), np.float32)
        for _ in range(2):
            q, _ = np.linalg.qr(q)
            q = a.T @ (a @ q)
        q, _ = np.linalg.qr(q)
        _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
        return (q @ vt.T)[:, :dims].astype(np.float32)

    def embed(self, got: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(got), self.axes.shape[1]), np.float32)
        for i, (at, w) in enumerate(got):
            if len(at):
                out[i] = self._weighted(at, w) @ self.axes[at]
        return _unit(out)

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """Votes of the nearest labelled vectors, found block by block."""
        k = min(NEIGHBOURS, len(self.vectors))
        if not k:
            return np.full(len(x), self.prior)
        sims, votes = np.full((len(x), 0), -2, np.float32), np.zeros((len(x), 0))
        for i in range(0, len(self.vectors), block):
            # rounded beyond single precision's noise, so that equal vectors are equally near in blocks of any size
            s = np.concatenate([sims, (x @ self.vectors[i : i + block].T).round(5)], 1)
            y = np.concatenate([votes, np.broadcast_to(self.labels[i : i + block], (len(x), len(self.labels[i : i + block])))], 1)
            near = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            least = np.take_along_axis(s, near, 1).min(1)
            tied = (s >= least[:, None]).sum(1) > k
            near[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
            near.sort(axis=1)  # in the order of the labelled rows, for ties with later blocks
            sims, votes = np.take_along_axis(s, near, 1), np.take_along_axis(y, near, 1)
        w = np.maximum(sims, 0).astype(np.float64) ** SHARPNESS
        total = w.sum(1)
        return np.where(total > 0, (w * votes).sum(1) / np.where(total > 0, total, 1), self.prior)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality", sample=SAMPLE) -> Model:
    """A model from labelled rows that are not held out (``held_out``)."""
    y = pick(labels, doc_id=label_id, label=label_col).select(F.col("doc_id").cast("long"), F.col("label").cast("int"))
    y = y.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    rows = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").orderBy("doc_id", F.xxhash64("text")).limit(sample)
    got = rows.mapInArrow(_terms_of, "label int, terms array<long>, weights array<double>").collect()
    return Model([(r.label, np.array(r.terms, np.int64), np.array(r.weights)) for r in got])


def held_out(col: str):
    """Rows that are never learnt from: crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % 5 == 0


def _score(model):
    def run(batches):
        m, terms = model.value, Terms()
        for b in slices(batches):
            got = [terms(t) for t in b.column("text").to_pylist()]
            s = m.score(m.embed(got))
            s[[not len(g[0]) for g in got]] = m.prior
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(s, 0, 1))], names=[*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text, score."""
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, text string, score double")


def predictions(scored: DataFrame, threshold=THRESHOLD) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(model, threshold, text):
    def run(batches):
        m, terms = model.value, Terms()
        for b in slices(batches, text):
            got = [terms(t) for t in b.column(text).to_pylist()]
            s = m.score(m.embed(got))
            s[[not len(g[0]) for g in got]] = m.prior
            yield b.filter(pa.array(s >= threshold))

    return run


def keep(docs: DataFrame, model: Model, *, text_col="text", threshold=THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without rows that score under ``threshold``."""
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return flat.mapInArrow(_keep(held, threshold, f"_c{docs.columns.index(text_col)}"), flat.schema).toDF(*docs.columns)
