"""Best-fit packing by bin completion over the counts of lengths.

Method: only how many pieces there are of each length (1 to ``capacity``)
decides how to pack, so the search works on at most ``capacity`` numbers however
many documents there are. Take the largest remaining length; enumerate the
undominated fillings of the room around it (a filling is dominated if an
item that is left over can take the place of some of its items, or of the waste),
of however many items; order them by waste, the best fit first; apply the chosen
one to as many sequences as the counts allow. The first descent gives the
best-fit solution as incumbent. Branch and bound goes back over the alternatives
(the filling in fewer sequences, then the other fillings), cuts a branch whose
waste so far leaves no room for a better solution, and ends at the lower bound,
when all is searched, or after ``nodes`` choices. Sequences and lower bound are
logged, and ``bounds`` gives them as a row.

A piece then finds its place by its rank among the pieces of its length. Ranks
are counted in (length, salt) groups of about ``GROUP`` pieces, so a length that
a third of all pieces share is ranked by many tasks.

Defined results: null and empty texts are one piece, the end id alone; a text
whose ids with the end id fit is never cut; repeated rows are packed each;
an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import materialise, pick, slices
from evidencelake.llm.tokens import word_ids

CAPACITY, NODES, GROUP = 2048, 60_000, 2048
#: choices of a path whose enumerations are held
LIVE = 64
END = b"\0\0\0\0"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path, capacity, with_ids):
    def run(batches):
        ids = word_ids(path)
        for b in slices(batches):
            docs = b.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            step = 4 * capacity
            for d, raw in zip(docs, ids.encode(b.column("text").to_pylist()), strict=True):
                raw += END
                for i, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for col, v in zip(out, (d, i, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(v)
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([array("I", x).tolist() for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, *, id_col="doc_id", text_col="text", capacity=CAPACITY, tokenizer: str | None = None, with_ids=False) -> DataFrame:
    """Token pieces of whole texts, the end id 0 after each; ``with_ids`` adds the ids themselves."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_cut(tokenizer, capacity, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: total length, and for each k pieces over capacity - k with what can't join them."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    n, s = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    half = capacity // 2
    for k in range(half + 1):
        big = int(n[-1] - n[capacity - k + 1])  # alone: nothing of k or longer joins them
        mid = int(n[capacity - k + 1] - n[half + 1])  # longer than half
        rest = int(s[half + 1] - s[k])  # from k to half
        room = mid * capacity - int(s[capacity - k + 1] - s[half + 1])
        best = max(best, big + mid + max(0, -(-(rest - room) // capacity)))
    return best


def _copies(bits: int, x: int, n: int) -> int:
    """Subset sums after up to ``n`` more items of length ``x``."""
    k = 1
    while n > 0:
        bits |= bits << min(k, n) * x
        n, k = n - k, 2 * k
    return bits


def dominated(f: tuple[int, ...], spare: int, waste: int) -> bool:
    """Whether a spare item (a bit of ``spare`` for each length) can take the place of some of ``f`` (descending) that are no longer together."""
    sums, last = 1, 0
    for x, n in sorted(Counter(f).items()) + [(None, 0)]:
        near, wide = sums, 1  # sums of the items shorter than the spare one, and up to ``waste`` more
        while wide <= waste:
            near |= near << min(wide, waste + 1 - wide)
            wide *= 2
        among = spare >> last + 1 << last + 1
        if x is not None:
            among &= (1 << x + 1) - 1
        if near & among:
            return True
        if x is not None:
            sums, last = _copies(sums, x, n), x
    return False


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``room``, of any number of items, the least waste first; None for each dominated one met.

    Of equal waste, those of larger items come first. Sums that the shorter
    lengths can reach are kept as bits, so each step down leads to a filling.
    The first one is never dominated.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0].tolist()
    many = [int(counts[x]) for x in have]
    reach, mask = [1], (1 << room + 1) - 1
    for x, n in zip(have, many, strict=True):
        reach.append(_copies(reach[-1], x, min(n, room // x)) & mask)

    def exact(i: int, target: int):
        if not target:
            yield ()
            return
        for j in range(min(i, bisect_right(have, target)), 0, -1):
            if not reach[j] >> target & 1:
                return
            x = have[j - 1]
            for c in range(min(many[j - 1], target // x), 0, -1):
                if reach[j - 1] >> target - c * x & 1:
                    for rest in exact(j - 1, target - c * x):
                        yield (x,) * c + rest

    def found():
        for target in range(room, -1, -1):
            if not reach[-1] >> target & 1:
                continue
            for f in exact(len(have), target):
                used = Counter(f)
                spare = sum(1 << x for x, n in zip(have, many, strict=True) if n > used[x])
                yield None if dominated(f, spare, room - target) else f

    return found()


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((lengths in a sequence, how many such sequences) ..., lower bound) by branch and bound."""
    counts = np.asarray(counts, np.int64).copy()
    bound = lower_bound(counts, capacity)
    left = int((counts * np.arange(len(counts))).sum())
    best, best_bins = None, None
    path: list[list] = []  # [largest length, its fillings or None, how many were taken, filling applied, times]
    bins, used = 0, 0

    def around(big: int, skip: int):
        counts[big] -= 1
        found = fillings(counts, capacity - big)
        counts[big] += 1
        return islice(found, skip, None)

    def change(f: tuple[int, ...], times: int) -> None:
        nonlocal bins, left
        for x in f:
            counts[x] -= times
        bins += times
        left -= times * sum(f)

    while True:
        hopeless = best_bins is not None and bins + -(-left // capacity) >= best_bins
        if not left and not hopeless:
            best, best_bins = [(f, t) for *_, f, t in path], bins
        elif left and not hopeless:
            big = int(np.flatnonzero(counts)[-1])
            path.append([big, around(big, 0), 0, (), 0])
            if len(path) > LIVE:
                path[-LIVE - 1][1] = None  # made again if the search comes back
        while path:  # the next choice: the same filling in fewer sequences, then another filling, then an earlier choice
            if best is not None and (best_bins <= bound or used >= nodes):
                return best, bound
            step = path[-1]
            big, found, skip, f, times = step
            change(f, -times)
            used += 1
            if times > 1:
                step[4] -= 1
                break
            step[1] = found = found or around(big, skip)
            f = next(found, False)
            step[2:] = skip + 1, (), 0
            if f is None:
                continue
            if f is not False:
                f = (big, *f)
            # those that follow waste as much or more
            if f is False or (best_bins is not None and bins + 1 + -(-(left - sum(f)) // capacity) >= best_bins):
                path.pop()
                continue
            step[3:] = f, min(int(counts[x]) // n for x, n in Counter(f).items())
            break
        if not path:
            return best or [], bound
        change(*path[-1][3:])


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks: key = length * 2^40 + first rank; the range's first sequence, copies in each, offsets."""
    rows, rank, base = [], {}, 0
    for f, times in plan:
        offs: dict[int, list[int]] = {}
        at = 0
        for x in f:
            offs.setdefault(x, []).append(at)
            at += x
        for x, o in offs.items():
            first = rank.get(x, 0)
            rows.append(((x << 40) + first, base, len(o), o))
            rank[x] = first + times * len(o)
        base += times
    rows.sort()
    return {
        "key": np.array([r[0] for r in rows], np.int64), "base": np.array([r[1] for r in rows], np.int64),
        "each": np.array([r[2] for r in rows], np.int64), "at": np.cumsum([0, *(r[2] for r in rows)])[:-1].astype(np.int64),
        "offsets": np.array([o for r in rows for o in r[3]], np.int64),
    }


def _place(plan):
    def run(batches):
        p = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(p["key"], (length << 40) + rank, side="right") - 1
            k = rank - (p["key"][i] & ((1 << 40) - 1))
            seq = p["base"][i] + k // p["each"][i]
            off = p["offsets"][p["at"][i] + k % p["each"][i]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def plan_of(cut: DataFrame, *, capacity=CAPACITY, nodes=NODES):
    """Pieces by length, the plan of ``complete`` and the lower bound."""
    sizes = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in sizes.items():
        counts[x] = n
    plan, bound = complete(counts, capacity, nodes)
    made = sum(t for _, t in plan)
    logging.getLogger(__name__).log(logging.WARNING if made > bound else logging.INFO, "%d sequences, lower bound %d", made, bound)
    return sizes, plan, bound


def bounds(cut: DataFrame, *, capacity=CAPACITY, nodes=NODES) -> DataFrame:
    """sequences, lower_bound: what ``pack`` makes of these pieces and what no packing goes below."""
    _, plan, bound = plan_of(cut, capacity=capacity, nodes=nodes)
    return cut.sparkSession.createDataFrame([(sum(t for _, t in plan), bound)], "sequences long, lower_bound long")


def pack(cut: DataFrame, *, capacity=CAPACITY, nodes=NODES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``cut`` is read three times: give a written table."""
    spark = cut.sparkSession
    sizes, plan, _ = plan_of(cut, capacity=capacity, nodes=nodes)
    salts = spark.createDataFrame([(x, -(-n // GROUP)) for x, n in sizes.items()], "length long, salts long")
    rows = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    firsts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(firsts.select("length", "salt", F.coalesce("base", F.lit(0)).alias("base")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(_places(plan))), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", capacity=CAPACITY, nodes=NODES, tokenizer: str | None = None) -> DataFrame:
    """Cut, write the pieces to the shared folder (so that texts are tokenized once) and pack them."""
    cut = materialise(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer=tokenizer), "pieces")
    return pack(cut, capacity=capacity, nodes=nodes)
