"""Near-duplicate groups by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

Method: a document's set is its distinct ``SHINGLE``-word shingles. Rows with
equal sets are put together first and go on as one node. A node has a signature
of ``TREES * DEPTH`` MinHash values. Each tree of the forest is one sorted order:
the signature rotated by the tree's offset. Nodes that share the first ``DEPTH``
values of an order form a region; within it, the ``WINDOW`` neighbours on either
side in sorted order, those of the longest common prefix, are candidates, so how
deep a prefix they share adapts to how dense the region is. Two nodes at the
threshold of 0.75 miss all regions with probability (1 - 0.75^3)^20 = 2e-5.

Candidates are confirmed in rounds: each group tries its most promising link,
and groups that meet are merged (``graph.components``). After ``ROUNDS`` rounds
few groups are left of a cluster of thousands of copies. What remains is settled
exactly, so the window is no cap: in every region that still holds several
groups, all pairs between groups are looked at, in blocks of ``BLOCK`` nodes
spread over tasks. A group of that size or more has blocks of its own, which
don't meet each other, so a giant cluster with a few strays in its region is sent
once. A pair is looked at in the first tree where it shares a
region; those that agree in ``AGREE`` values or more are compared on full sets
in place, and only links found are sent on.

Signatures only choose what is compared (two documents at the threshold agree in
fewer than ``AGREE`` values with odds of 1e-5); a link counts if
``100 * |intersection| >= 75 * |union|`` of the full sets.

Sorted orders are range-partitioned, which splits regions of any size;
neighbours across a partition's edge are found from the edge rows, ``JOINED``
partitions at a time and then those groups' edges. Joins on a set, a region or a
group that many rows share leave these rows where they are (``graph.join_keyed``).

Defined results: a text without words (null, empty) has no shingles and links to
nothing; with fewer words than a shingle the whole sequence is the one shingle;
rows of one id are one document: their texts are compared each, and all of them
are in one group; a row without an id links to nothing, its component is null and
it is kept; texts of any length are read whole; ties between links are tried by
the smaller nodes first and change no group; an empty table gives no rows;
columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import discard, lean, materialise, pick, slices
from evidencelake.llm.graph import PLAIN, components, join_keyed

SHINGLE, TREES, DEPTH, WINDOW = 5, 20, 3, 4
VALUES = TREES * DEPTH
AGREE = 30
NUMERATOR, DENOMINATOR = 75, 100
BLOCK, ROUNDS, JOINED = 1024, 2, 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    counts = [len(w) for w in split]
    h = np.fromiter((xxhash.xxh64_intdigest(w) for ws in split for w in ws), np.uint64, sum(counts))
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * _ODD + h[j : n + j]
    g = _mix(g)
    out, at = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(g[at : at + c - k + 1]))
        elif c:
            x = np.array([c], np.uint64)
            for i in range(at, at + c):
                x = _mix(x * _ODD + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def signature(s: np.ndarray, block: int = 8192) -> bytes:
    """MinHash values, each folded to 16 bits, big-endian so that bytes sort as values do."""
    low = None
    for i in range(0, len(s), block):
        part = ((s[i : i + block, None] ^ _XOR) * _MULT).min(0)
        low = part if low is None else np.minimum(low, part)
    return (_mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """On sorted distinct shingles."""
    if min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _signatures(batches):
    for b in slices(batches):
        sets = shingle_sets(b.column("text").to_pylist())
        prints = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(s + _ODD)))) if len(s) else (0, 0) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(np.array([p[i] for p in prints], np.uint64).view(np.int64)) for i in range(2)),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "text_key", "n_shingles", "fp1", "fp2", "sig"],
        )


SIGNED = "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, sig binary"
KEYS = "grp int, resolved boolean, keys binary, nodes binary, counts binary"
_KEYS_ARROW = pa.schema([("grp", pa.int32()), ("resolved", pa.bool_()), ("keys", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())])


def _regions(sigs: np.ndarray) -> np.ndarray:
    """The region of each node in each tree, as (tree, first values) in one number."""
    v = sigs.astype(np.uint64).reshape(len(sigs), TREES, DEPTH)
    out = np.repeat(np.arange(TREES, dtype=np.uint64)[None], len(sigs), 0)
    for d in range(DEPTH):
        out = out << np.uint64(16) | v[:, :, d]
    return out


def _send_regions(groups):
    """A region met once in this task is sent with its node; one met more often is known to be shared, and sent once."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u2").reshape(-1, VALUES)
            keys = _regions(sigs).ravel()
            nodes = np.repeat(b.column("node").to_numpy(), TREES)
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order], nodes[order]
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(new, len(keys)))
            rows = []
            many = np.repeat(n > 1, n)
            if many.any():
                rows.append((int(nodes[0] % groups), True, keys[many].tobytes(), nodes[many].astype("<i8").tobytes(), b""))
            grp = (_mix(keys[new]) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(grp, kind="stable")
            bounds = np.flatnonzero(np.diff(grp[by], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(by)], strict=True):
                i = by[lo:hi]
                rows.append((int(grp[i[0]]), False, keys[new[i]].tobytes(), nodes[new[i]].astype("<i8").tobytes(), n[i].astype("<u4").tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KEYS_ARROW, strict=True)], schema=_KEYS_ARROW)

    return run


def _shared_regions(table: pa.Table) -> pa.Table:
    """(node, trees): a bit for each tree in which the node's region holds another node."""
    get = lambda c, t, done: [np.frombuffer(x.as_buffer(), t) for x, r in zip(table.column(c), table.column("resolved").to_pylist(), strict=True) if r == done]
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    keys, nodes, counts = (cat(get(c, t, False), t) for c, t in (("keys", "<u8"), ("nodes", "<i8"), ("counts", "<u4")))
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    shared = np.zeros(len(s), bool)
    if len(s):
        shared[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), new) > 1, np.diff(np.append(new, len(s))))
    keys, nodes = np.concatenate([keys[shared], cat(get("keys", "<u8", True), "<u8")]), np.concatenate([nodes[shared], cat(get("nodes", "<i8", True), "<i8")])
    bits = np.left_shift(np.int64(1), (keys >> np.uint64(16 * DEPTH)).astype(np.int64))
    order = np.argsort(nodes, kind="stable")
    nodes, bits = nodes[order], bits[order]
    new = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.empty(0, np.int64)
    return pa.table({"node": pa.array(nodes[new], pa.int64()), "trees": pa.array(np.bitwise_or.reduceat(bits, new) if len(new) else bits, pa.int64())})


def _fits(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.minimum(na, nb) * DENOMINATOR >= np.maximum(na, nb) * NUMERATOR


NEIGHBOURS = "a long, b long, agree int, part int, place int, ord binary, node long, n long"
_NEIGHBOURS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("part", pa.int32()), ("place", pa.int32()), ("ord", pa.binary()), ("node", pa.int64()), ("n", pa.int64())])


def _values(ords: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(o[1:] for o in ords), ">u2").reshape(len(ords), VALUES).astype(np.uint16)


def _pairs(ords, nodes, n, first, window):
    """Candidates (i, i - d), i >= first, d up to the window, of one region."""
    v, r = _values(ords), np.frombuffer(b"".join(o[: 1 + 2 * DEPTH] for o in ords), np.uint8).reshape(len(ords), -1)
    for d in range(1, window + 1):
        i = np.arange(max(first, d), len(ords))
        if not len(i):
            continue
        i = i[(r[i] == r[i - d]).all(1) & _fits(n[i], n[i - d]) & (nodes[i] != nodes[i - d])]
        agree = (v[i] == v[i - d]).sum(1)
        ok = agree >= AGREE
        yield i[ok], i[ok] - d, agree[ok]


def _neighbour_rows(a, b, agree, part=None, place=None, ords=None, nodes=None, n=None):
    k, m = len(a), len(nodes) if nodes is not None else 0
    pad = lambda x, t: pa.array([*[None] * k, *x], t) if m else pa.nulls(k, t)
    cand = lambda x, t: pa.array([*x, *[None] * m], t) if m else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [cand(a, pa.int64()), cand(b, pa.int64()), cand(agree, pa.int32()), pad([part] * m, pa.int32()), pad(place if m else [], pa.int32()), pad(ords or [], pa.binary()), pad(nodes if m else [], pa.int64()), pad(n if m else [], pa.int64())],
        names=["a", "b", "agree", "part", "place", "ord", "node", "n"],
    )


def _neighbours(window):
    """Over one sorted partition: candidates, and the rows at its edges."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen: set = set()
        ords: list = []
        nodes, n = np.empty(0, np.int64), np.empty(0, np.int64)
        head_done = False
        for b in batches:
            if not b.num_rows:
                continue
            first = len(ords)
            ords = ords + b.column("ord").to_pylist()
            nodes, n = np.concatenate([nodes, b.column("node").to_numpy()]), np.concatenate([n, b.column("n").to_numpy()])
            a, c, g = [], [], []
            for i, j, agree in _pairs(ords, nodes, n, first, window):
                x, y = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
                for p in zip(x.tolist(), y.tolist(), agree.tolist(), strict=True):
                    if p[:2] not in seen:
                        seen.add(p[:2])
                        a.append(p[0])
                        c.append(p[1])
                        g.append(p[2])
            if len(seen) > 500_000:
                seen.clear()
            edge = {}
            if not head_done:
                k = min(window, len(ords))
                edge = {"part": part, "place": list(range(k)), "ords": ords[:k], "nodes": nodes[:k].tolist(), "n": n[:k].tolist()}
                head_done = True
            yield _neighbour_rows(a, c, g, **edge)
            ords, nodes, n = ords[-window:], nodes[-window:], n[-window:]
        if ords:
            yield _neighbour_rows([], [], [], part=part, place=list(range(1000, 1000 + len(ords))), ords=ords, nodes=nodes.tolist(), n=n.tolist())

    return run


def _stitch(window):
    """Candidates between the last rows of a partition and the first of later ones, and the edge rows of all of them together."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("place", "ascending")])
        ords, nodes, n, part = t.column("ord").to_pylist(), t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("part").to_numpy()
        # a short partition gives its rows twice, as head and as tail
        once = [i for i in range(len(ords)) if i == 0 or (part[i], ords[i], nodes[i]) not in {(part[j], ords[j], nodes[j]) for j in range(max(0, i - 2 * window), i)}]
        ords, nodes, n, part = [ords[i] for i in once], nodes[once], n[once], part[once]
        found: tuple[list, list, list] = ([], [], [])
        for i, j, agree in _pairs(ords, nodes, n, 1, window):
            ok = part[i] != part[j]
            for f, x in zip(found, (np.minimum(nodes[i], nodes[j])[ok], np.maximum(nodes[i], nodes[j])[ok], agree[ok]), strict=True):
                f.extend(x.tolist())
        k = min(window, len(ords))
        ends = [*range(k), *range(len(ords) - k, len(ords))]
        grp = key[0].as_py()
        return pa.Table.from_batches([_neighbour_rows(*found, part=grp, place=[*range(k), *range(1000, 1000 + k)], ords=[ords[i] for i in ends], nodes=nodes[ends].tolist(), n=n[ends].tolist())]).cast(_NEIGHBOURS_ARROW)

    return run


def _check(batches):
    """Pairs with both texts -> those linked."""
    for b in slices(slices(batches, "text_a", 1 << 20), "text_b", 1 << 20):
        left, right = shingle_sets(b.column("text_a").to_pylist()), shingle_sets(b.column("text_b").to_pylist())
        ok = [linked(x, y) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _suspects(v, tree, comp, n, i, j):
    """Of pairs (i, j) in a region of ``tree``: those between groups that may be linked and share no earlier region; and how far they agree."""
    ok = (comp[i] != comp[j]) & _fits(n[i], n[j])
    i, j = i[ok], j[ok]
    out = [], [], []
    for lo in range(0, len(i), 100_000):
        x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
        same = v[x] == v[y]
        agree = same.sum(1)
        shared = same.reshape(-1, TREES, DEPTH).all(2)  # of trees tree, tree + 1, ... round to tree - 1
        order = (np.arange(TREES)[None] + tree[x][:, None]) % TREES
        ok = (agree >= AGREE) & (np.where(shared, order, TREES).min(1) == tree[x])
        for o, a in zip(out, (x, y, agree), strict=True):
            o.append(a[ok])
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def _pairs_of(keys: np.ndarray, side: np.ndarray):
    """Index pairs within each run of equal keys: all of a block with itself (side 2), or one side with the other."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    size = ends - starts
    small = np.repeat(size <= 64, size) & (side == 2)
    for d in range(1, int(min(64, size.max()))):
        i = np.flatnonzero(small[:-d] & small[d:] & (keys[d:] == keys[:-d]))
        if len(i):
            yield i, i + d
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        if side[lo] == 2 and hi - lo <= 64:
            continue
        left, right = np.arange(lo, hi)[side[lo:hi] != 1], np.arange(lo, hi)[side[lo:hi] != 0]
        for at in range(0, len(left), 128):
            i, j = np.meshgrid(left[at : at + 128], right, indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = (i < j) | (side[lo] != 2)
            yield i[ok], j[ok]


def _spread(table: pa.Table):
    """A bucket's rows by (region, blocks, side) with their arrays."""
    t = table.sort_by([("region", "ascending"), ("x", "ascending"), ("y", "ascending"), ("side", "ascending"), ("node", "ascending")])
    ords = t.column("ord").to_pylist()
    names = np.array([f"{r.hex()}/{x}/{y}" for r, x, y in zip(t.column("region").to_pylist(), t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True)])
    _, keys = np.unique(names, return_inverse=True)
    tree = np.array([o[0] for o in ords], np.int64)
    return t, keys, t.column("side").to_numpy(), _values(ords), tree, t.column("component").to_numpy(), t.column("n").to_numpy(), t.column("node").to_numpy()


def _find_suspects(table: pa.Table) -> pa.Table:
    """The rows that are in a pair worth comparing."""
    t, keys, side, v, tree, comp, n, _ = _spread(table)
    mark = np.zeros(len(keys), bool)
    for i, j in _pairs_of(keys, side):
        x, y, _ = _suspects(v, tree, comp, n, i, j)
        mark[x] = mark[y] = True
    return t.filter(pa.array(mark)).drop_columns(["bucket"])


def _compare(table: pa.Table) -> pa.Table:
    """Links between groups, on full sets; pairs whose groups a link of this bucket has joined need no check."""
    t, keys, side, v, tree, comp, n, node = _spread(table)
    texts = dict(zip(node.tolist(), t.column("text").to_pylist(), strict=True))
    sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    a, b = [], []
    for i, j in _pairs_of(keys, side):
        x, y, agree = _suspects(v, tree, comp, n, i, j)
        order = np.argsort(-agree, kind="stable")
        for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
            c, d = root(int(comp[p])), root(int(comp[q]))
            if c != d and linked(sets[int(node[p])], sets[int(node[q])]):
                up[max(c, d)] = min(c, d)
                a.append(int(comp[p]))
                b.append(int(comp[q]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _label(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the component of ``col``; a node without a label is its own."""
    m = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return df.join(m, F.col(col) == F.col("_n"), "left").withColumn(out, F.coalesce("_c", col)).drop("_n", "_c")


def _confirm(candidates: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after ``ROUNDS`` rounds in which each group tries its most promising candidate (a, b, agree)."""
    rest, used = candidates, []
    for _ in range(ROUNDS):
        cross = _label(_label(rest, labels, "a", "ca"), labels, "b", "cb").filter("ca != cb").select("a", "b", "agree", "ca", "cb")
        cross = materialise(cross, "cross")
        ends = cross.select(F.col("ca").alias("c"), "a", "b", "agree").unionByName(cross.select(F.col("cb").alias("c"), "a", "b", "agree"))
        best = ends.groupBy("c").agg(F.max(F.struct("agree", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("m"))
        chosen = best.select((-F.col("m.x")).alias("a"), (-F.col("m.y")).alias("b")).distinct()
        ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        checked = materialise(chosen.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(_check, "a long, b long, ok boolean"), "checked")
        labels = _joined(labels, _label(_label(checked.filter("ok"), labels, "a", "ca"), labels, "b", "cb"), "ca", "cb")
        rest = cross.select("a", "b", "agree").join(checked.select("a", "b"), ["a", "b"], "left_anti")
        used += [cross, checked]
    for df in used:
        discard(df)
    return labels


def _regrouped(df: DataFrame, by: DataFrame, col: str, out: str, rows: int) -> DataFrame:
    """As ``_label``, for a written table of so many rows in which many may have the same ``col``."""
    if rows <= PLAIN:
        return _label(df, by, col, out)
    every = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return join_keyed(df, _label(every, by, col, out), col, rows)


def _joined(labels: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Labels after merging the groups that ``links`` (of components) connect."""
    found = components(links, a, b)
    known = labels.select("node").unionByName(found.select("node")).distinct()
    old = _label(known, labels, "node", "old")
    rows = known.count()
    if rows > PLAIN:
        old = materialise(old, "old")
    return materialise(_regrouped(old, found, "old", "component", rows).select("node", "component"), "labels")


def _settle(member: DataFrame, rows: int, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after comparing, in every region with several groups, all pairs between them."""
    m = _label(member.withColumn("region", F.expr(f"substring(ord, 1, {1 + 2 * DEPTH})")), labels, "node", "component")
    if rows > PLAIN:
        m = materialise(m, "regions")
    sizes = m.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c"))
    blocks = lambda n: F.ceil(n / BLOCK)
    own = F.when(F.col("c") >= BLOCK, F.struct("component", blocks(F.col("c")).alias("blocks")))
    r = sizes.groupBy("region").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("few"), F.sort_array(F.collect_list(own)).alias("own"))
    # blocks 0 to shared - 1 are of small groups, then come those of each large one
    r = r.filter("groups > 1").withColumn("shared", blocks(F.col("few")))
    first = F.expr("transform(own, (x, i) -> named_struct('component', x.component, 'blocks', x.blocks, 'first', shared + aggregate(slice(own, 1, i), 0L, (s, y) -> s + y.blocks)))")
    r = r.withColumn("own", first).withColumn("total", F.expr("shared + aggregate(own, 0L, (s, y) -> s + y.blocks)")).drop("groups", "few")
    d = join_keyed(m, r, "region", rows).withColumn("mine", F.expr("get(filter(own, x -> x.component = component), 0)"))
    d = d.withColumn("block", F.expr("if(mine is null, pmod(xxhash64(node), shared), mine.first + pmod(xxhash64(node), mine.blocks))"))
    d = d.withColumn("other", F.explode(F.expr("filter(sequence(0L, total - 1), o -> mine is null or o < mine.first or o >= mine.first + mine.blocks)")))
    side = F.expr("case when block = other then 2 when block < other then 0 else 1 end")
    d = materialise(d.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "ord", "node", "component", "n"), "mixed")
    schema = "region binary, x long, y long, side int, ord binary, node long, component long, n long"
    buckets = max(1, -(-d.count() // 20_000))
    by = F.pmod(F.xxhash64("region", "x", "y"), F.lit(buckets))
    # the two sides of a pair of blocks share (region, x, y), so they meet in one bucket
    found = materialise(d.withColumn("bucket", by).groupBy("bucket").applyInArrow(lean(_find_suspects), schema), "suspects")
    size = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # shingles, about eight bytes of text each
    by = F.pmod(F.xxhash64("region", "x", "y"), F.lit(max(1, -(-size // (2 << 20)))))
    links = found.join(texts, "node").withColumn("bucket", by).groupBy("bucket").applyInArrow(lean(_compare), "a long, b long")
    labels = _joined(labels, links, "a", "b")
    for df in (d, found):
        discard(df)
    return labels


def _link(sets: DataFrame, rows: DataFrame, total: int, window: int) -> DataFrame:
    """node, component of the sets that are linked."""
    buckets = max(1, -(-total * TREES * 16 // (16 << 20)))
    shared = sets.select("node", "sig").mapInArrow(_send_regions(buckets), KEYS).groupBy("grp").applyInArrow(lean(_shared_regions), "node long, trees long")
    shared = shared.groupBy("node").agg(F.bit_or("trees").alias("trees"))
    member = sets.select("node", "sig", F.col("n_shingles").alias("n")).join(shared, "node")
    member = member.withColumn("t", F.explode(F.expr(f"filter(sequence(0, {TREES - 1}), t -> getbit(trees, t) = 1)")))
    turn = f"concat(unhex(lpad(hex(t), 2, '0')), substring(sig, {2 * DEPTH} * t + 1), substring(sig, 1, {2 * DEPTH} * t))"
    member = materialise(member.select(F.expr(turn).alias("ord"), "node", "n"), "forest")
    members = member.count()
    ordered = member.repartitionByRange(max(1, -(-members // 50_000)), "ord", "node").sortWithinPartitions("ord", "node")
    near = materialise(ordered.mapInArrow(_neighbours(window), NEIGHBOURS), "neighbours")
    level = near.filter(F.col("node").isNotNull()).withColumn("grp", F.expr(f"part div {JOINED}").cast("int")).groupBy("grp").applyInArrow(_stitch(window), NEIGHBOURS)
    level = materialise(level, "edges")  # as many rows as sorted partitions have edges
    above = level.filter(F.col("node").isNotNull()).withColumn("grp", F.lit(0)).groupBy("grp").applyInArrow(_stitch(window), NEIGHBOURS)  # 2 * window rows for JOINED partitions
    found = [df.filter(F.col("a").isNotNull()).select("a", "b", "agree") for df in (near, level, above)]
    pairs = materialise(found[0].unionByName(found[1]).unionByName(found[2]).groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")
    # texts that may be compared: of candidates, and of regions larger than the window
    region = member.withColumn("region", F.expr(f"substring(ord, 1, {1 + 2 * DEPTH})"))
    wide = region.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > window + 1)
    inside = join_keyed(region.select("region", "node"), wide, "region", members).select("node")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(inside).distinct()
    wanted = sets.select("node", F.col("lo").alias("doc_id"), "text_key").join(ids, "node", "left_semi")
    texts = materialise(rows.join(wanted, ["doc_id", "text_key"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels = rows.sparkSession.createDataFrame([], "node long, component long")
    labels = _settle(member, members, texts, _confirm(pairs, texts, labels))
    for df in (member, near, level, pairs, texts):  # labels are written; nothing reads these any more
        discard(df)
    return labels


def groups(docs: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    signed = materialise(rows.mapInArrow(_signatures, SIGNED), "signatures")
    # equal sets are one node; a written table, so its numbers stay
    some = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = some.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    sets = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "n_shingles", "fp1", "fp2", F.col("m.doc_id").alias("lo"), F.col("m.text_key").alias("text_key"), "sig", "copies"), "sets")
    total, count = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    labels = _link(sets, rows, total, window) if total > 1 else spark.createDataFrame([], "node long, component long")

    key = F.struct("n_shingles", "fp1", "fp2").alias("key")
    node = sets.select(key, "node", F.col("copies").alias("n"))
    placed = join_keyed(some.select("doc_id", key), node, "key", count).select("doc_id", F.col("key.n_shingles").alias("n_shingles"), "node")
    bare = signed.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("node"))
    placed = materialise(placed.unionByName(bare), "placed")
    # rows of one id are one document, whatever their texts
    ids = placed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count_if(F.col("node").isNull()).alias("bare"), F.count(F.lit(1)).alias("n"))
    ids = materialise(ids.filter("first IS NOT NULL AND (first < last OR bare > 0)"), "ids")
    if repeated := ids.count():
        same = join_keyed(placed.filter("node IS NOT NULL"), ids.select("doc_id", "first", "n"), "doc_id", count).select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        labels = _joined(labels, _label(_label(same, labels, "a", "ca"), labels, "b", "cb"), "ca", "cb")

    # the smallest id of each group, then of each node, then of each row
    own = _label(sets.select("node", "lo", "copies"), labels, "node", "component")
    if total > PLAIN:
        own = materialise(own, "own")
    least = own.groupBy("component").agg(F.min("lo").alias("component_id"), F.count(F.lit(1)).alias("n"))
    node = join_keyed(own, least, "component", total).select("node", "component_id", F.col("copies").alias("n"))
    linked_ = join_keyed(placed.filter("node IS NOT NULL"), node, "node", count).select("doc_id", "n_shingles", "component_id")
    bare = placed.filter("node IS NULL").select("doc_id", "n_shingles")
    if repeated:
        of = ids.filter("bare > 0").select(F.col("doc_id").alias("_d"), F.col("first").alias("node")).join(node.drop("n"), "node").select("_d", "component_id")
        bare = bare.join(of, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    else:
        bare = bare.withColumn("component_id", F.col("doc_id"))
    out = linked_.unionByName(bare)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with all its columns, with one document (the smallest id) of each group; rows of one id stay together."""
    gone = groups(docs, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return flat.join(gone, F.col(f"_c{docs.columns.index(id_col)}").cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)
