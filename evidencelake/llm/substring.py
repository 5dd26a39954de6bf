"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Suffixes start at every word of every document. A word goes if a window of
``window`` words that covers it also starts earlier: the leaves below a deep
internal node (depth ``window`` or more) are the starts of one repeated word
sequence, and all but the earliest leaf mark their window for removal.

A tree (``Subtree``) is its leaves in sorted order with the length of the prefix
each shares with the one before: an internal node is a run of neighbours that
share so many words, so nodes of depth ``window`` or more are read off that
array. Words are numbered exactly, suffixes are sorted by doubling (ranks of 1, 2,
4, ... words), and no hash decides what is equal.

Three rounds, each a shuffle of packed arrays (one row per task and group):

1. Prefix counts. Of every window's suffixes only one is looked at, the one
   whose ``PREFIX``-word prefix has the smallest hash: equal windows pick equal
   prefixes, so a window whose prefix occurs once in all documents lies below no
   deep node. This leaves about one suffix in eight to count and rules out most
   of a corpus without its suffixes ever being moved.
2. Groups. The remaining windows are split by a prefix of variable length: the
   ``PREFIX``-word prefix picked in round 1 while its group is small, the whole
   window where more than ``HEAVY`` suffixes share that prefix. Equal windows
   meet in the same group either way. Neighbouring windows of a group go as one
   segment of words.
3. Subtrees. A task builds the tree of its group's suffixes; what its deep nodes
   hold besides the earliest leaf is marked. A repeat longer than a segment is
   the union of the windows that its segments' nodes mark.

Hot sequences are reduced before they are moved: a task sends a prefix once,
with its count, however many of its documents hold it; and in round 2 it builds
the trees of its own documents first, marks their later copies and sends what is
left. Groups are sized by ``group_bytes`` of text, so memory
does not depend on the input; on executors with more memory a larger value keeps
the packed rows long on very large inputs. The list of heavy prefixes is broadcast; it
has at most ``HEAVY_MOST`` entries, as the limit rises with the corpus.

Documents are ordered by (doc_id, hash of the text), null ids last; repeated rows
of one id and text are one document and get the same result each. Null, empty
and short texts have no window and stay as they are; texts of any length are
read whole; an empty table gives no rows; columns other than those named are not
read. Hashes (64 bits) of prefixes and windows only say where suffixes meet: a
collision adds a comparison and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import lean, materialise, pick, slices

WINDOW, PREFIX = 20, 6
GROUP_BYTES = 16 << 20
HEAVY, HEAVY_MOST = 4096, 100_000
FLUSH = 24 << 20
#: Words of a shelf's documents that go into one tree before anything is sent.
TREE_WORDS = 1 << 19

_NULL_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: packed rows: docs, keys and counts say whose the entries are, in order
PACKED = "grp int, kind int, docs binary, keys binary, counts binary, at binary, hashes binary, extra binary, words binary"
_FIELDS = ("docs", "keys", "counts", "at", "hashes", "extra", "words")
_TYPES = {"docs": "<i8", "keys": "<i8", "counts": "<u4", "at": "<u4", "hashes": "<u8", "extra": "<u4", "words": "u1"}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def path_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place, over words laid end to end."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _ODD
        out += h[j : n + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Laid:
    """Documents laid end to end: their words' hashes, windows and the prefix each window picks."""

    def __init__(self, texts: list[str | None], window: int, prefix: int):
        split = [t.encode().split() if t else [] for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.words = [w for ws in split for w in ws]
        h = word_hashes(self.words)
        owner = np.repeat(np.arange(len(split)), self.counts)
        n = len(h) - window + 1
        if n <= 0:
            self.starts = self.picks = np.empty(0, np.int64)
            self.paths = self.prefixes = np.empty(0, np.uint64)
            self.owner = np.empty(0, np.int64)
            return
        starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
        g = path_hashes(h, prefix)
        self.paths = path_hashes(h, window)[starts]
        self.picks = (sliding_window_view(g, window - prefix + 1)[:n].argmin(1) + np.arange(n))[starts]
        self.starts, self.owner, self.prefixes = starts, owner[starts], g

    def local(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return at - self.firsts[owner]


def _rows(grp: np.ndarray, kind: int, docs: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes=None, extra=None):
    """Entries dealt to groups; ``docs``/``keys`` are those of each entry, in order of documents."""
    order = np.argsort(grp, kind="stable")
    bounds = np.flatnonzero(np.diff(grp[order], prepend=-1))
    for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
        i = order[lo:hi]
        d, k = docs[i], keys[i]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
        yield (
            int(grp[i[0]]), kind, d[new].astype("<i8").tobytes(), k[new].astype("<i8").tobytes(), np.diff(np.append(new, len(i))).astype("<u4").tobytes(),
            at[i].astype("<u4").tobytes(), hashes[i].astype("<u8").tobytes() if hashes is not None else b"", extra[i].astype("<u4").tobytes() if extra is not None else b"", b"",
        )


_PACKED_ARROW = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), *((f, pa.binary()) for f in _FIELDS)])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _PACKED_ARROW]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _batches(rows):
    for b in _table(list(rows)).to_batches():
        if b.num_rows:
            yield b


def _unpack(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """All entries of a kind, with the document of each."""
    rows = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    got = {}
    for f in _FIELDS[:-1]:
        col = table.column(f)
        got[f] = np.concatenate([np.frombuffer(col[i].as_buffer(), _TYPES[f]) for i in rows]) if rows else np.empty(0, _TYPES[f])
    counts = got.pop("counts")
    got["docs"], got["keys"] = np.repeat(got["docs"], counts), np.repeat(got["keys"], counts)
    return got


def _shelf(docs: np.ndarray, keys: np.ndarray, shelves: int) -> np.ndarray:
    """The group a document is kept in."""
    x = docs.astype(np.uint64) * _ODD ^ keys.astype(np.uint64)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % shelves


def _count_prefixes(window, prefix, groups, shelves):
    """Round 1, before the shuffle: kind 0 is a prefix sent once with its count, kind 1 the places of prefixes known to be shared."""

    def send(held):
        hashes, docs, keys, at = (np.concatenate([h[i] for h in held]) for i in range(4))
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        n = np.diff(np.append(new, len(s)))
        first = np.sort(order[new])
        count = np.zeros(len(hashes), np.int64)
        count[order[new]] = n
        yield from _batches(_rows((hashes[first] % np.uint64(groups)).astype(np.int64), 0, docs[first], keys[first], at[first], hashes[first], count[first]))
        many = np.sort(order[np.repeat(n > 1, n)])
        if len(many):
            yield from _batches(_rows(_shelf(docs[many], keys[many], shelves), 1, docs[many], keys[many], at[many]))

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            x = Laid(b.column("text").to_pylist(), window, prefix)
            new = np.flatnonzero(np.concatenate(([True], x.picks[1:] != x.picks[:-1]))) if len(x.picks) else np.empty(0, np.int64)
            picks, owner = x.picks[new], x.owner[new]
            docs, keys = b.column("doc_id").to_numpy(), b.column("text_key").to_numpy()
            held.append((x.prefixes[picks] if len(picks) else np.empty(0, np.uint64), docs[owner], keys[owner], x.local(picks, owner)))
            size += b.nbytes
            if size >= FLUSH:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return run


def _share_prefixes(heavy, shelves):
    """Round 1, after it: kind 1 are places of shared prefixes, by the shelf of their document; kind 2 are heavy prefixes."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpack(table, 0)
        out = []
        if len(x["hashes"]):
            order = np.argsort(x["hashes"], kind="stable")
            s = x["hashes"][order]
            new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            total = np.add.reduceat(x["extra"][order].astype(np.int64), new)
            n = np.diff(np.append(new, len(s)))
            shared = np.zeros(len(s), bool)
            shared[order] = np.repeat(total > 1, n)
            i = np.flatnonzero(shared & (x["extra"] == 1))  # places of those counted higher are on their shelf already
            if len(i):
                out += _rows(_shelf(x["docs"][i], x["keys"][i], shelves), 1, x["docs"][i], x["keys"][i], x["at"][i])
            if (total > heavy).any():
                out.append((0, 2, b"", b"", b"", b"", s[new[total > heavy]].astype("<u8").tobytes(), b"", b""))
        return pa.concat_tables([_table(out), table.filter(pc.equal(table.column("kind"), 1)).cast(_PACKED_ARROW)])

    return run


def _texts(shelves):
    """Documents packed for their shelf."""

    def send(held):
        docs, keys, texts = (sum((h[i] for h in held), []) for i in range(3))
        d, k = np.array(docs, np.int64), np.array(keys, np.int64)
        shelf = _shelf(d, k, shelves)
        rows = []
        for s in np.unique(shelf):
            i = np.flatnonzero(shelf == s).tolist()
            raw = [texts[j].encode() if texts[j] is not None else b"" for j in i]
            body = b"".join(raw)
            rows.append((int(s), d[i].astype("<i8").tobytes(), k[i].astype("<i8").tobytes(), np.array([len(r) for r in raw], "<u8").tobytes(), len(body), pa.compress(body, "zstd", asbytes=True)))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:4]), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())], names=["shelf", "docs", "keys", "sizes", "length", "body"])

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            held.append((b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text").to_pylist()))
            size += b.nbytes
            if size >= FLUSH:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return run


TEXTS = "shelf int, docs binary, keys binary, sizes binary, length long, body binary"


def _open(table: pa.Table):
    """(doc, key, text) of a shelf, a packed row at a time."""
    for r in range(table.num_rows):
        docs, keys, sizes = (np.frombuffer(table.column(c)[r].as_buffer(), t).tolist() for c, t in (("docs", "<i8"), ("keys", "<i8"), ("sizes", "<u8")))
        body = pa.decompress(table.column("body")[r].as_buffer(), table.column("length")[r].as_py(), "zstd", asbytes=True)
        at, texts = 0, []
        for n in sizes:
            texts.append(body[at : at + n].decode())
            at += n
        yield docs, keys, texts


def _chunks(table: pa.Table, most: int = 2 << 20):
    for docs, keys, texts in _open(table):
        at = 0
        while at < len(docs):
            to, size = at, 0
            while to < len(docs) and (to == at or size + len(texts[to]) <= most):
                size += len(texts[to])
                to += 1
            yield np.array(docs[at:to], np.int64), np.array(keys[at:to], np.int64), texts[at:to]
            at = to


def _ordinal(docs: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in the order of (document, place)."""
    order = np.lexsort((keys, docs))
    d, k = docs[order], keys[order]
    rank = np.empty(len(docs), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))).astype(np.uint64)
    return rank << np.uint64(32) | at.astype(np.uint64)


class Subtree:
    """The suffix tree of the first ``leaves[i]`` suffixes of each segment of words, as sorted leaves and shared lengths.

    ``order`` has the leaves (numbered through the segments) as they sort,
    ``shared`` how many words each has in common with the one before it, up to
    the next power of two above ``window``, less one.
    """

    def __init__(self, segments: Iterable[list[bytes]], leaves: np.ndarray, window: int):
        names: dict[bytes, int] = {}
        number = names.setdefault
        parts = [np.fromiter((number(w, len(names)) for w in s), np.int32, len(s)) for s in segments]  # the words themselves are not held
        n = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts) if parts else np.empty(0, np.int32)
        del parts
        # a mark of its own ends each segment, so nothing is shared beyond it
        first = np.cumsum(n + 1) - (n + 1)
        top = 1 << window.bit_length() - 1
        ids = np.full(int(n.sum()) + len(n) + 2 * top, len(names) + len(n), np.int32)
        ids[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        ids[first + n] = len(names) + np.arange(len(n))
        ranks, k = {1: ids}, 1
        while k < top:
            r = ranks[k]
            ranks[2 * k] = np.unique(r[:-k] * (np.int64(r.max()) + 1) + r[k:], return_inverse=True)[1].astype(np.int32)
            k *= 2
        count = np.asarray(leaves, np.int64)
        at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        head = ranks[top]
        self.order = np.lexsort((head[at + top - 1], head[at]))
        a, b = at[self.order[:-1]], at[self.order[1:]]
        depth = np.zeros(len(a), np.int64)
        while k:
            r = ranks[k]
            depth += k * (r[a + depth] == r[b + depth])
            k //= 2
        self.shared = np.concatenate(([0], depth)) if len(at) else depth
        self.window = window

    def nodes(self) -> list[tuple[int, int, int]]:
        """(depth, first leaf in order, last) of the internal nodes of depth ``window`` or more, parents after their children."""
        out, held = [], []
        for i, d in enumerate([*self.shared.tolist(), 0]):
            low = i - 1
            while held and held[-1][0] > d:
                depth, low = held.pop()
                out.append((depth, low, i - 1))
            if d >= self.window and (not held or held[-1][0] < d):
                held.append((d, low))
        return out

    def later(self, ordinal: np.ndarray) -> np.ndarray:
        """Leaves below deep nodes that aren't their node's earliest ones."""
        new = np.flatnonzero(self.shared < self.window)
        o = ordinal[self.order]
        earliest = np.repeat(np.minimum.reduceat(o, new), np.diff(np.append(new, len(o)))) if len(o) else o
        out = np.zeros(len(o), bool)
        out[self.order] = o != earliest  # the same place of a repeated row is not later
        return out


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of runs, from where they begin."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _segments(grp, docs, keys, at, starts, words, window):
    """Windows in order of place, those next to each other in one group as one segment, packed by group."""
    first, n = _runs(np.concatenate(([True], (grp[1:] != grp[:-1]) | (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1] + 1))))
    order = np.argsort(grp[first], kind="stable")
    first, n = first[order], n[order]
    lows, counts = _runs(np.concatenate(([True], grp[first][1:] != grp[first][:-1])))
    for lo, k in zip(lows.tolist(), counts.tolist(), strict=True):
        f, m = first[lo : lo + k], n[lo : lo + k]
        body = b"\n".join(b" ".join(words[a : a + c + window - 1]) for a, c in zip(starts[f].tolist(), m.tolist(), strict=True))
        packed = len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)
        yield (int(grp[f[0]]), 0, docs[f].astype("<i8").tobytes(), keys[f].astype("<i8").tobytes(), np.ones(k, "<u4").tobytes(), at[f].astype("<u4").tobytes(), b"", m.astype("<u4").tobytes(), packed)


def _read_segments(table: pa.Table) -> Iterator[list[bytes]]:
    for kind, raw in zip(table.column("kind").to_pylist(), table.column("words").to_pylist(), strict=True):
        if not kind:
            body = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
            for s in body.split(b"\n"):
                yield s.split(b" ")


def _suffixes(window, prefix, groups, shelves, heavy):
    """Round 2: windows whose prefix is shared go to their group (kind 0), later copies on this shelf straight to removal (kind 1)."""

    def local(held):
        """The tree of some documents of the shelf."""
        words, size, parts = [], 0, ([], [], [], [], [])
        for x, w, docs, keys, grp in held:
            owner = x.owner[w]
            for p, v in zip(parts, (x.starts[w] + size, docs[owner], keys[owner], x.local(x.starts[w], owner), grp), strict=True):
                p.append(v)
            words += x.words
            size += len(x.words)
        starts, docs, keys, at, grp = map(np.concatenate, parts)
        first, n = _runs(np.concatenate(([True], starts[1:] != starts[:-1] + 1)))
        tree = Subtree((words[a : a + c + window - 1] for a, c in zip(starts[first].tolist(), n.tolist(), strict=True)), n, window)
        later = tree.later(_ordinal(docs, keys, at))
        go, stay = np.flatnonzero(later), np.flatnonzero(~later)
        out = list(_rows(_shelf(docs[go], keys[go], shelves), 1, docs[go], keys[go], at[go])) if len(go) else []
        return out + list(_segments(grp[stay], docs[stay], keys[stay], at[stay], starts[stay], words, window))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        places = _unpack(known, 1)
        if not len(places["at"]) or not texts.num_rows:
            return _table([])
        big = heavy.value
        shared: dict[tuple[int, int], np.ndarray] = {}
        order = np.lexsort((places["keys"], places["docs"]))
        d, k, a = places["docs"][order], places["keys"][order], places["at"][order]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
        for lo, hi in zip(new, [*new[1:], len(d)], strict=True):
            shared[int(d[lo]), int(k[lo])] = a[lo:hi]
        held, size, out = [], 0, []
        for docs, keys, body in _chunks(texts):
            some = [i for i, x in enumerate(zip(docs.tolist(), keys.tolist(), strict=True)) if x in shared]
            if not some:
                continue
            docs, keys = docs[some], keys[some]
            x = Laid([body[i] for i in some], window, prefix)
            if not len(x.starts):
                continue
            mark = np.zeros(len(x.prefixes), bool)
            for i, id_ in enumerate(zip(docs.tolist(), keys.tolist(), strict=True)):
                mark[x.firsts[i] + shared[id_]] = True
            w = np.flatnonzero(mark[x.picks])
            pre = x.prefixes[x.picks[w]]
            route = np.where(np.isin(pre, big), x.paths[w], pre) if len(big) else pre
            held.append((x, w, docs, keys, (route % np.uint64(groups)).astype(np.int64)))
            size += len(x.words)
            if size >= TREE_WORDS:
                out += local(held)
                held, size = [], 0
        if held:
            out += local(held)
        return _table(out)

    return run


def _subtrees(window, shelves):
    """Round 3: leaves below deep internal nodes, but for the earliest of each."""

    def run(table: pa.Table) -> pa.Table:
        x = _unpack(table, 0)
        out = []
        if len(x["at"]):
            n = x["extra"].astype(np.int64)
            docs, keys = np.repeat(x["docs"], n), np.repeat(x["keys"], n)
            at = np.repeat(x["at"].astype(np.int64), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = np.flatnonzero(Subtree(_read_segments(table), n, window).later(_ordinal(docs, keys, at)))
            if len(i):
                out += _rows(_shelf(docs[i], keys[i], shelves), 1, docs[i], keys[i], at[i])
        return pa.concat_tables([_table(out), table.filter(pc.equal(table.column("kind"), 1)).cast(_PACKED_ARROW)])

    return run


RESULT = "doc_id long, text_key long, n_words long, n_removed long, kept string, kept_sha256 string"


def _cut(window):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        places = _unpack(known, 1)
        order = np.lexsort((places["keys"], places["docs"]))
        d, k, a = places["docs"][order], places["keys"][order], places["at"][order].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))) if len(d) else np.empty(0, np.int64)
        bounds = {(int(d[lo]), int(k[lo])): (lo, hi) for lo, hi in zip(new, np.append(new[1:], len(d))[: len(new)], strict=True)}
        cols: list[list] = [[], [], [], [], [], []]
        for docs, keys, body in _open(texts):
            for doc, key, text in zip(docs, keys, body, strict=True):
                words = text.encode().split()
                n, gone = len(words), 0
                if (b := bounds.get((doc, key))) is not None:
                    starts = a[b[0] : b[1]]
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.minimum(starts + window, n), -1)
                    stays = np.cumsum(cover[:n]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    gone = n - len(words)
                kept = b" ".join(words)
                for c, v in zip(cols, (doc if doc != _NULL_ID else None, key, n, gone, kept.decode() if gone else text, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
        return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "text_key", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW, prefix=PREFIX, group_bytes=GROUP_BYTES, heavy=HEAVY) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, n_removed, kept (the text as it was if nothing goes), kept_sha256."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = shelves = max(1, -(-total // group_bytes))
    heavy = max(heavy, total // 50 // HEAVY_MOST)  # at least 50 bytes of text for each prefix counted
    counted = rows.mapInArrow(_count_prefixes(window, prefix, groups, shelves), PACKED)
    known = materialise(counted.groupBy("grp").applyInArrow(lean(_share_prefixes(heavy, shelves)), PACKED), "prefixes")
    big = [np.frombuffer(r.hashes, "<u8") for r in known.filter("kind = 2").select("hashes").collect()]
    big = spark.sparkContext.broadcast(np.sort(np.concatenate(big)) if big else np.empty(0, np.uint64))
    texts = rows.mapInArrow(_texts(shelves), TEXTS)
    sent = texts.groupBy("shelf").cogroup(known.filter("kind = 1").groupBy("grp")).applyInArrow(lean(_suffixes(window, prefix, groups, shelves, big)), PACKED)
    gone = sent.groupBy("grp").applyInArrow(lean(_subtrees(window, shelves)), PACKED)
    return texts.groupBy("shelf").cogroup(gone.groupBy("grp")).applyInArrow(lean(_cut(window)), RESULT)


def clean(docs: DataFrame, *, id_col="doc_id", text_col="text", chars_col: str | None = None, **how) -> DataFrame:
    """``docs`` with all its columns, without repeated passages in the text; ``chars_col`` gets the new length."""
    cut = remove_repeats(docs, id_col=id_col, text_col=text_col, **how).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("kept").alias("_kept")).dropDuplicates(["_d", "_k"])
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = {c: f"_c{docs.columns.index(c)}" for c in (id_col, text_col, chars_col) if c}
    key = (F.coalesce(F.col(at[id_col]).cast("long"), F.lit(_NULL_ID)) == F.col("_d")) & (F.xxhash64(at[text_col]) == F.col("_k"))
    out = flat.join(cut, key, "left")
    new = {at[text_col]: F.coalesce("_kept", at[text_col])}
    if chars_col:
        was = flat.schema[at[chars_col]].dataType
        new[at[chars_col]] = F.when(F.col("_kept").isNull(), F.col(at[chars_col])).otherwise(F.length("_kept").cast(was))
    return out.withColumns(new).select(*flat.columns).toDF(*docs.columns)


def report(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")
