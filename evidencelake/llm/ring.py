"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions only.

Method: every shard has ``vnodes`` points on a ring of ``CELLS`` cells. A row's
key (``doc_id``) hashes to a cell and goes clockwise to the next point. The load
bound is exact: shards hold ``floor(n / shards)`` rows, the shards with the
largest own arcs one more where n asks for it. A shard first takes rows of its own arcs, in ring
order; rows beyond its bound continue clockwise to the next shard with room.

Only counts are needed to decide that: one aggregation gives the rows of each
(arc, salt), at most shards * vnodes * SALTS numbers whatever the input size.
The driver walks the ring once over them and gets, for each arc, which ranks go
to which shard and at which slot; each row then finds its piece by its rank in
its arc. A salt from the text splits an arc, so that a key that holds a large
share of the rows is ranked by many tasks.

Defined results: a null key has a hash of its own; null text has no bytes, so
size 8, and crc32 0; repeated rows each get a place; an empty table gives no
rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import pick

SHARDS, VNODES, SALTS = 24, 64, 16
CELL_BITS = 14


def _ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """For each cell its arc, and for each arc (in clockwise order) its shard."""
    cells = 1 << CELL_BITS
    if shards * vnodes > cells:
        raise ValueError(f"{shards} x {vnodes} points don't fit on {cells} cells")
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            c = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while c in at:  # an occupied cell: the next free one
                c = (c + 1) % cells
            at[c] = s
    order = sorted(at)
    arcs, i = [], 0
    for c in range(cells):
        while i < len(order) and order[i] < c:
            i += 1
        arcs.append(i % len(order))
    return arcs, [at[c] for c in order]


def flows(counts: dict[int, int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank); ``counts`` are the rows of each arc."""
    n = sum(counts.values())
    own = [0] * shards
    for a, c in counts.items():
        own[owner[a]] += c
    room = [n // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[: n % shards]:
        room[s] += 1
    used, out, over = [0] * shards, [], [0] * len(owner)

    def take(arc: int, at: int, k: int, s: int) -> None:
        out.append((arc, at, at + k, s, used[s]))
        used[s] += k
        room[s] -= k

    for a, s in enumerate(owner):
        c = counts.get(a, 0)
        k = min(c, room[s])
        if k:
            take(a, 0, k, s)
        over[a] = k
    waiting: deque = deque()
    for lap in range(2):
        for a, s in enumerate(owner):
            if not lap and counts.get(a, 0) > over[a]:
                waiting.append((a, over[a], counts[a]))
            while waiting and room[s]:
                arc, at, end = waiting.popleft()
                k = min(end - at, room[s])
                take(arc, at, k, s)
                if at + k < end:
                    waiting.appendleft((arc, at + k, end))
    return out


def assign(df: DataFrame, *, id_col="doc_id", text_col="text", shards=SHARDS, vnodes=VNODES) -> DataFrame:
    """doc_id, size, text_crc32, arc, shard, slot: row counts of any two shards differ by one at most."""
    spark = df.sparkSession
    arcs, owner = _ring(shards, vnodes)
    # bounded: 2^CELL_BITS rows
    cells = spark.createDataFrame([(c, a) for c, a in enumerate(arcs)], "cell int, arc int")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull())
    rows = pick(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int")).withColumn("salt", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(SALTS)).cast("int"))
    rows = rows.join(F.broadcast(cells), "cell")
    counts = {(r.arc, r.salt): r["n"] for r in rows.groupBy("arc", "salt").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_arc: dict[int, int] = {}
    bases = []
    for (a, s), n in sorted(counts.items()):
        bases.append((a, s, by_arc.get(a, 0)))
        by_arc[a] = by_arc.get(a, 0) + n
    pieces: dict[int, list] = {}
    for a, lo, hi, s, slot in sorted(flows(by_arc, owner, shards)):
        pieces.setdefault(a, []).append((lo, hi, s, slot))
    # bounded: shards * vnodes * SALTS numbers, and shards * vnodes arcs whose pieces are shards + arcs at most in all
    bases = spark.createDataFrame(bases, "arc int, salt int, base long")
    table = spark.createDataFrame(list(pieces.items()), "arc int, pieces array<struct<lo:long,hi:long,shard:int,slot:long>>")
    order = Window.partitionBy("arc", "salt").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(bases), ["arc", "salt"]).join(F.broadcast(table), "arc")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).withColumn("piece", F.filter("pieces", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0])
    return ranked.select("doc_id", "size", "text_crc32", "arc", F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("rank") - F.col("piece.lo")).alias("slot"))
