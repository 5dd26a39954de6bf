r"""Multi-party perspective rotation of conversations, by DataFrame functions only.

Method: for every participant of a conversation (each speaker but ``system``)
the whole dialogue is rendered with that speaker as the assistant, all others as
users named after their role, and the system turns as they are. Text and closing
mark of the speaker's own turns are trained on, everything else is masked.

A rendering is kept as its turns in order, each with its segment and the
segment's place in the whole (``start`` to ``stop``, in characters), so a
dialogue of any length is spread over rows: concatenate ``segment`` by ``start``
to get the string (``join_turns`` does that). Offsets come from a two-level
prefix sum: per chunk of ``CHUNK`` turn numbers, then within the chunk. Turns meet
the participants chunk by chunk, so a conversation with a third of all turns is
the work of many tasks.

Defined results: marks in a text or a name are broken by a backslash (``<\|``),
so they open and close no turn, and white space in a name is one space in its
mark; null text is empty, and sorts so; turns with one number are ordered by role
(a null role last) and text; turns without a number come last, ordered by the MD5
of role and text, by which they are chunked too; a null role is a nameless user
in every rendering and never a participant; repeated rows are repeated turns; a
conversation of system turns only has no rendering; a null conv_id is a
conversation; texts of any length are rendered whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 256


def _plain(text: Column) -> Column:
    """Text that holds no mark."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", r"<\\|$1|>")


def rotate(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", system="system") -> DataFrame:
    """conv_id, perspective, turn, seat, name, segment, start, stop, train_start, train_stop (equal where masked)."""
    t = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("turn", F.col("turn").cast("long"))
    t = t.withColumn("text", F.coalesce("text", F.lit("")))
    loose = F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), "text").cast("binary"))
    t = t.withColumn("loose", F.when(F.col("turn").isNull(), loose))
    t = t.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(1 << 62) + F.conv(F.substring("loose", 1, 3), 16, 10).cast("long")))
    people = t.filter(F.col("role").isNotNull() & (F.col("role") != system)).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    parts = t.select(F.col("conv_id").alias("_d"), F.col("chunk").alias("_k")).distinct()
    cells = parts.join(people, F.col("_d").eqNullSafe(F.col("_c"))).drop("_c")
    r = t.join(cells, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("chunk") == F.col("_k"))).drop("_d", "_k")
    seat = F.when(F.col("role") == F.col("perspective"), "assistant").when(F.col("role") == system, "system").otherwise("user")
    r = r.withColumn("seat", seat).withColumn("name", F.when(F.col("seat") == "user", F.col("role")))
    head = F.concat(F.lit(START), "seat", F.coalesce(F.concat(F.lit(" name="), _plain(F.regexp_replace("name", r"\s+", " "))), F.lit("")), F.lit("\n"))
    r = r.withColumn("segment", F.concat(head, _plain(F.col("text")), F.lit(END))).withColumn("head", F.length(head)).withColumn("n", F.length("segment").cast("long"))
    prior = Window.unboundedPreceding, -1
    sums = r.groupBy("conv_id", "perspective", "chunk").agg(F.sum("n").alias("cn"))
    sums = sums.withColumn("base", F.coalesce(F.sum("cn").over(Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(*prior)), F.lit(0)))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("chunk").alias("_k"), "base")
    order = Window.partitionBy("conv_id", "perspective", "chunk").orderBy(F.col("turn").asc_nulls_last(), "loose", F.col("role").asc_nulls_last(), "text")
    r = r.withColumn("in_chunk", F.coalesce(F.sum("n").over(order.rowsBetween(*prior)), F.lit(0)))
    r = r.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("chunk") == F.col("_k")))
    start = F.col("base") + F.col("in_chunk")
    stop = start + F.col("n")
    train = F.when(F.col("seat") == "assistant", start + F.col("head")).otherwise(stop)
    return r.select("conv_id", "perspective", "turn", "seat", "name", "segment", start.alias("start"), stop.alias("stop"), train.alias("train_start"), stop.alias("train_stop"))


def join_turns(rendered: DataFrame) -> DataFrame:
    """One string and its trained character spans for each (conv_id, perspective), for dialogues known to fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("start", "segment", "train_start", "train_stop")))
    g = rendered.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: F.struct(p["train_start"].alias("start"), p["train_stop"].alias("stop"))), lambda s: s["start"] < s["stop"])
    return g.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), spans.alias("spans"))
