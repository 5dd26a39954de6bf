"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Fit: a k-means tree (``branch`` children a node, leaves of about ``leaf``
sampled vectors) on at most ``sample`` vectors, chosen by a hash of the id; that
bound and the tree's size don't grow with the table. Every vector of the table
is then indexed: it goes to the leaf it descends to.

Search: a query keeps a priority queue of subtrees by distance to their centre,
opens the nearest, and lists the leaves it reaches in that order. How many
leaves it visits is calibrated: sampled vectors are used as queries against
brute force over the sample, and visits are doubled until ``recall`` is met. A
query goes on past that number until the leaves it has visited hold ``k`` vectors
besides its own and ``LEAST`` in all, or none are left, so it gets ``k`` rows
wherever the table has them; that holds for tables of every size. ``measure`` gives recall and the share of leaves and vectors visited for
queries of the table that the tree was not fitted on.

Leaves are dealt to buckets of about ``BUCKET`` vectors; a leaf with more than
``GROUP`` vectors is cut into salted units that go to different buckets. A query
is sent once to each bucket that holds units it visits, with their list; there,
blocks of queries and of a unit's vectors are multiplied; every vector whose
product is within rounding of the ``k + 1`` smallest is compared by its exact
distance, ties at the last place by their ids, and the bucket gives each query at
most ``k`` rows. Very many queries are cut into blocks too. Equal
vectors are first put together with their ``k + 1`` smallest ids, which is exact
as ties go to the smaller id, so a vector that a third of all rows share is
compared once.

Defined results: vectors that are null, zero, of another width than the first
sampled, or hold null or non-finite components take no part, nor do null ids;
of rows with the same id and vector one counts; a query with fewer than ``k``
candidates in the table gets all of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import materialise, pick

SAMPLE, BRANCH, LEAF, RECALL, GROUP = 8192, 16, 64, 0.97, 2048
BUCKET, QUERIES = 16_384, 20_000
SALT_BITS = 24
#: Distinct vectors that a query sees at least.
LEAST = 2048
FOUND = "query_id long, rank int, vec_id long, score double"


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of distinct starting points."""
    x0 = np.unique(x, axis=0)
    c = x0[rng.choice(len(x0), min(k, len(x0)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


class Tree:
    """Nodes in breadth-first order; a leaf has no children."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [x.mean(0) if len(x) else np.zeros(1)]
        self.children: list[list[int]] = [[]]
        queue = [(0, x)]
        while queue:
            node, mine = queue.pop(0)
            if len(mine) <= leaf or len(np.unique(mine, axis=0)) <= 1:
                continue
            c = _kmeans(mine, branch, rng)
            near = _nearest(mine, c)
            for j in range(len(c)):
                part = mine[near == j]
                if len(part):
                    self.children[node].append(len(self.centres))
                    queue.append((len(self.centres), part))
                    self.centres.append(c[j])
                    self.children.append([])
            if len(self.children[node]) == 1:  # nothing was split off
                only = self.children[node].pop()
                queue.pop()
                self.centres.pop(only)
                self.children.pop(only)
        self.blocks = [np.array([self.centres[i] for i in ch]) if ch else None for ch in self.children]
        self.leaves = sum(not ch for ch in self.children)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, from the root down."""
        at = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            nodes = at[todo]
            more = []
            for n in np.unique(nodes):
                ch = self.children[n]
                if ch:
                    rows = todo[nodes == n]
                    at[rows] = np.array(ch)[_nearest(x[rows], self.blocks[n])]
                    more.append(rows)
            todo = np.concatenate(more) if more else np.empty(0, np.int64)
        return at

    def visit(self, q: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves by best-bin-first traversal, and more until ``least`` vectors stand in them."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < leaves or held < least):
            _, n = heapq.heappop(heap)
            ch = self.children[n]
            if not ch:
                out.append(n)
                held += sizes.get(n, 0) if sizes else 0
                continue
            d = ((self.blocks[n] - q) ** 2).sum(1)
            for c, v in zip(ch, d.tolist(), strict=True):
                heapq.heappush(heap, (v, c))
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """The least number of visits, by doubling, that reaches ``recall`` of the true neighbours within the sample."""
    if len(x) <= k or tree.leaves == 1:
        return tree.leaves
    at = tree.place(x)
    rng = np.random.default_rng(11)
    qs = rng.choice(len(x), min(queries, len(x)), replace=False)
    orders = [tree.visit(x[i], tree.leaves) for i in qs]
    truth = []
    for i in qs:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        truth.append(at[np.argpartition(d, k)[:k]])
    visits = 1
    while visits < tree.leaves:
        found = np.mean([np.isin(t, o[:visits]).mean() for t, o in zip(truth, orders, strict=True)])
        if found >= recall:
            return visits
        visits *= 2
    return tree.leaves


def clean(df: DataFrame, *, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """vec_id, v: the vectors that take part."""
    v = pick(df, vec_id=id_col, v=vec_col).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))


def _rows(col) -> np.ndarray:
    """An Arrow list column of equal widths as a matrix."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _index(tree):
    def run(batches):
        t = tree.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t.place(_rows(b.column("v"))))], names=[*b.schema.names, "leaf"])

    return run


def _bucket(unit: np.ndarray, buckets: int) -> np.ndarray:
    x = unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _dealt(buckets):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(b.column("unit").to_numpy(), buckets)), *b.columns], names=["bucket", *b.schema.names])

    return run


def _visits(tree, visits, sizes, least, group, buckets, blocks):
    """Queries, once for each bucket that holds units they visit."""

    def run(batches):
        t, held = tree.value, sizes.value
        for b in batches:
            rows, at, units = [], [], []
            for i, q in enumerate(_rows(b.column("v")) if b.num_rows else ()):
                mine = np.array([(leaf << SALT_BITS) + s for leaf in t.visit(q, visits, held, least) for s in range(-(-held.get(leaf, 0) // group))], np.int64)
                where = _bucket(mine, buckets)
                for k in np.unique(where):
                    rows.append(i)
                    at.append(int(k))
                    units.append(mine[where == k])
            if rows:
                got = b.take(pa.array(rows))
                block = got.column("query_id").to_numpy() % blocks
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(block), *got.columns, pa.array(units, pa.list_(pa.int64()))], names=["bucket", "block", "query_id", "v", "units"])

    return run


def _compare(k):
    """A bucket's queries against the units each visits; each query's k nearest ids by exact distance."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        left, right = left.combine_chunks(), right.combine_chunks()
        q, x = (_rows(t.column("v").combine_chunks()) for t in (left, right))
        unit = right.column("unit").to_numpy()
        ids = right.column("ids").to_pylist()
        lists = left.column("units").to_pylist()
        asks: dict[int, list[int]] = {}
        for i, us in enumerate(lists):
            for u in us:
                asks.setdefault(u, []).append(i)
        firsts = np.array([v[0] for v in ids], np.int64)
        norms = (x**2).sum(1)
        order = np.argsort(unit, kind="stable")
        found: list[list] = [[] for _ in lists]
        bounds = np.flatnonzero(np.diff(unit[order], prepend=-1))
        for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
            who = asks.get(int(unit[order[lo]]))
            if not who:
                continue
            rows = order[lo:hi]
            if len(rows) <= k + 1:
                for w in who:
                    found[w].append(rows)
                continue
            near = norms[rows][None] - 2 * q[who] @ x[rows].T
            # k vectors besides the query's own, and what rounding, of the root too, can't tell from the last of them
            off = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt((q[who] ** 2).sum(1)) + np.sqrt(norms[rows].max())) ** 2
            among = ~(near > (np.partition(near, k, axis=1)[:, k] + off)[:, None])  # what overflows is compared too
            for w, cols in zip(who, among, strict=True):
                found[w].append(rows[cols])
        qs = left.column("query_id").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for i, parts in enumerate(found):
            if not parts:
                continue
            rows = np.concatenate(parts)
            d = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
            if len(rows) > k + 1:
                last = np.partition(d, k)[k]
                tied = np.unique(firsts[rows[d == last]])
                stay = (d < last) | ((d == last) & (firsts[rows] <= tied[min(k, len(tied) - 1)]))
                rows, d = rows[stay], d[stay]
            mine = sorted((dist, v) for r, dist in zip(rows.tolist(), d.tolist(), strict=True) for v in ids[r] if v != qs[i])[:k]
            out[0].extend([qs[i]] * len(mine))
            out[1].extend(v for _, v in mine)
            out[2].extend(dist for dist, _ in mine)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


class Fit:
    """The tree of a table's vectors, the visits calibrated for it and the vectors that take part; None where there are none."""

    def __init__(self, every: DataFrame, tree: Tree, visits: int, sampled: list[int]):
        self.every, self.tree, self.visits, self.sampled = every, tree, visits, sampled

    @classmethod
    def of(cls, df: DataFrame, *, k=10, id_col="vec_id", vec_col="embedding", sample=SAMPLE, branch=BRANCH, leaf=LEAF, recall=RECALL) -> Fit | None:
        every = clean(df, id_col=id_col, vec_col=vec_col)
        first = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # at most `sample` rows
        if first.empty:
            return None
        width = len(first["v"].iloc[0])
        x = np.unique(np.stack([v for v in first["v"] if len(v) == width]), axis=0)
        tree = Tree(x, branch, leaf)
        return cls(every.filter(F.size("v") == width), tree, calibrate(tree, x, k, recall), first["vec_id"].tolist())


def search(df: DataFrame, queries, *, k=10, id_col="vec_id", vec_col="embedding", sample=SAMPLE, branch=BRANCH, leaf=LEAF, recall=RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``df`` that the condition ``queries`` (on vec_id) marks.

    score is the Euclidean distance in double precision on the original vectors.
    """
    spark = df.sparkSession
    fit = Fit.of(df, k=k, id_col=id_col, vec_col=vec_col, sample=sample, branch=branch, leaf=leaf, recall=recall)
    return spark.createDataFrame([], FOUND) if fit is None else nearest(fit, queries, k)


def _placed(fit: Fit, k: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct vectors with their leaf and smallest ids; and how many stand in each leaf."""
    low = Window.partitionBy("v", "part").orderBy("vec_id")
    parts = fit.every.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(low)).filter(F.col("r") <= k + 1)
    vectors = parts.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    held = fit.every.sparkSession.sparkContext.broadcast(fit.tree)
    placed = materialise(vectors.mapInArrow(_index(held), "v array<double>, ids array<long>, leaf long"), "vectors")
    return placed, {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # leaves are bounded by the sample


def nearest(fit: Fit, queries, k=10) -> DataFrame:
    """``search`` with a tree that is there already."""
    every, spark = fit.every, fit.every.sparkSession
    held = spark.sparkContext.broadcast(fit.tree)
    placed, sizes = _placed(fit, k)
    total = sum(sizes.values())
    salts = {leaf: -(-n // GROUP) for leaf, n in sizes.items()}
    buckets = max(1, -(-total // BUCKET))
    asked = every.filter(queries).distinct().select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    left = asked.mapInArrow(_visits(held, fit.visits, spark.sparkContext.broadcast(sizes), max(k + 1, LEAST), GROUP, buckets, blocks), "bucket long, block long, query_id long, v array<double>, units array<long>")
    many = F.broadcast(spark.createDataFrame(list(salts.items()), "leaf long, salts long"))
    right = placed.join(many, "leaf").withColumn("salt", F.pmod(F.xxhash64("v"), "salts"))
    right = right.select(F.expr(f"shiftleft(leaf, {SALT_BITS}) + salt").alias("unit"), "v", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = right.mapInArrow(_dealt(buckets), "bucket long, unit long, v array<double>, ids array<long>, block long")
    near = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measure(df: DataFrame, *, k=10, queries=200, **how) -> dict[str, float]:
    """recall against brute force, and the shares of leaves and of distinct vectors visited, for at most ``queries`` vectors not fitted on (any, if there are too few)."""
    fit = Fit.of(df, k=k, **how)
    if fit is None:
        return {"recall": 1.0, "leaves": 0.0, "vectors": 0.0}
    spark = df.sparkSession
    seen = F.broadcast(spark.createDataFrame([(i,) for i in fit.sampled], "vec_id long"))
    others = fit.every.join(seen, "vec_id", "left_anti").orderBy(F.xxhash64("vec_id", F.lit(1))).limit(queries).collect()
    asked = others or fit.every.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(queries).collect()
    mine = F.col("vec_id").isin([r.vec_id for r in asked])
    got = {(r.query_id, r.vec_id): r.score for r in nearest(fit, mine, k).collect()}
    q = F.broadcast(spark.createDataFrame([(r.vec_id, r.v) for r in asked], "query_id long, q array<double>"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    pairs = fit.every.distinct().crossJoin(q).filter("vec_id <> query_id").select("query_id", "vec_id", gap.alias("d"))  # a stated query set against all rows
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    true = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id").collect()
    sizes = _placed(fit, k)[1]
    visits = [fit.tree.visit(np.array(r.v), fit.visits, sizes, max(k + 1, LEAST)) for r in asked]
    total = sum(sizes.values())
    return {
        "recall": sum((r.query_id, r.vec_id) in got for r in true) / max(1, len(true)),
        "leaves": sum(map(len, visits)) / (len(visits) * fit.tree.leaves),
        "vectors": sum(sizes.get(leaf, 0) for v in visits for leaf in v) / (len(visits) * total),
    }
