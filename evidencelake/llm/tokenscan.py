"""Token counts of documents in flat, unindexed token files, by scanning for the separator.

Method: a flat file is tokens only, little-endian unsigned integers of ``width``
bytes, each document ended by a separator id; nothing says where documents begin.
Files of any size are cut into ranges of ``BLOCK`` tokens that any task can read
and scan by itself: one vectorised comparison finds the separators of a range,
whose summary is how many there are and where the first and the last lie.
Documents that cross ranges are stitched by a prefix scan over the summaries: a
running count gives the number of documents ended before a range, a running
maximum the position of the last separator before it. The scan has two levels
(``SUPER`` ranges make one super-range), so a file of any size is scanned by many
tasks.

``write_stream`` makes such files of a table of documents, one for each task, in
the shared folder. A task names its file after its attempt and returns the ids of
its documents in the order written; only files named in that table, which Spark
commits once, are read, so a task that is lost and repeated leaves no trace in
the counts. Workers open the files through ``pyarrow.fs`` (file, hdfs, s3, gs,
abfs).

Defined results: documents without tokens count 0; tokens after a file's last
separator are a document with ``ended`` false; a file without tokens has no
documents; bytes at a file's end that don't fill a token are no token; null and
empty texts have no tokens; a null id keeps its row; repeated rows are documents
of their own, so each gets a row; very long texts are counted whole; an empty
table gives no rows; columns other than those named are not read, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import materialise, pick, scratch, slices
from evidencelake.llm.tokens import word_ids

#: Ids of the default vocabulary fit two bytes.
SEPARATOR, WIDTH = 49407, 2
BLOCK, SUPER = 1 << 18, 4096
#: Bytes of ranges that one task reads.
TASK_BYTES = 32 << 20

ORDER = "file string, ordinal long, doc_id long"
SUMMARY = "file string, block long, n long, ended long, first_at long, last_at long, inner array<long>"


def _write(path, separator, width, folder):
    def run(batches):
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        ids, end, docs, out = word_ids(path), separator.to_bytes(4, "little"), 0, None
        try:
            for b in slices(batches):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                tokens = np.frombuffer(b"".join(x for raw in ids.encode(b.column("text").to_pylist()) for x in (raw, end)), "<u4")
                if int(tokens.max()) >> 8 * width:
                    raise ValueError(f"token ids don't fit {width} bytes")
                out.write(tokens.astype(f"<u{width}").tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(docs, docs + n)), b.column("doc_id")], names=["file", "ordinal", "doc_id"])
                docs += n
        finally:
            if out is not None:
                out.close()

    return run


def write_stream(docs: DataFrame, *, id_col="doc_id", text_col="text", tokenizer: str | None = None, separator=SEPARATOR, width=WIDTH) -> tuple[str, DataFrame]:
    """The folder with one flat token file for each input partition that has rows; and (file, ordinal, doc_id)."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    sc = docs.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(scratch(docs.sparkSession, "tokens"))
    folder = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return folder, materialise(rows.mapInArrow(_write(tokenizer, separator, width, folder), ORDER), "order")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), path, size of the flat files in a folder; their content is not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("size"))


def ranges(files: DataFrame, *, width=WIDTH, block=BLOCK) -> DataFrame:
    """file, path, block, at, size: byte ranges of ``block`` tokens, spread over tasks whatever the files' sizes."""
    step = block * width
    whole = files.withColumn("size", F.col("size") - F.col("size") % width).filter("size > 0")
    cut = whole.withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {step})"))).withColumn("at", F.col("block") * step)
    total = whole.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return cut.select("file", "path", "block", "at", F.least(F.lit(step), F.col("size") - F.col("at")).alias("size")).repartition(max(1, -(-total // TASK_BYTES)), "file", "block")


def _summaries(separator, width):
    def run(batches):
        held: dict[str, object] = {}
        for b in batches:
            for file, path, block, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "path", "block", "at", "size")), strict=True):
                if path not in held:
                    for old in held.values():
                        old.close()
                    store, name = fs.FileSystem.from_uri(path)
                    held = {path: store.open_input_file(name)}
                tokens = np.frombuffer(held[path].read_at(size, at), f"<u{width}")
                if len(tokens) * width != size:
                    raise OSError(f"{path} is shorter than listed")
                found = np.flatnonzero(tokens == separator)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([len(found)], pa.int64()),
                        pa.array([found[0] if len(found) else None], pa.int64()), pa.array([found[-1] if len(found) else None], pa.int64()),
                        pa.array([np.diff(found) - 1], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "n", "ended", "first_at", "last_at", "inner"],
                )
        for old in held.values():
            old.close()

    return run


def count_tokens(files: DataFrame, *, separator=SEPARATOR, width=WIDTH, block=BLOCK) -> DataFrame:
    """file, ordinal (0-based, in file order), n_tokens, ended for ``files`` (file, path, size) of tokens alone."""
    s = materialise(ranges(files, width=width, block=block).mapInArrow(_summaries(separator, width), SUMMARY), "summaries").withColumn("super", F.floor(F.col("block") / SUPER))
    # level 1: where each super-block begins; its last separator, from its own start
    inside = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    s = s.withColumn("first", F.col("at") + F.col("first_at")).withColumn("last", F.col("at") + F.col("last_at"))
    s = s.withColumn("before", F.coalesce(F.sum("ended").over(inside), F.lit(0))).withColumn("prev", F.max("last").over(inside))
    # level 2: the same over super-blocks
    over = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    sup = s.groupBy("file", "super").agg(F.sum("n").alias("sn"), F.sum("ended").alias("sended"), F.max("last").alias("slast"))
    sup = sup.withColumn("base", F.coalesce(F.sum("sn").over(over), F.lit(0)))
    sup = sup.withColumn("sbefore", F.coalesce(F.sum("sended").over(over), F.lit(0))).withColumn("sprev", F.max(F.col("base") + F.col("slast")).over(over))
    j = s.join(sup.select("file", "super", "base", "sbefore", "sprev"), ["file", "super"])
    last = F.coalesce(F.col("base") + F.col("prev"), F.col("sprev"), F.lit(-1))
    docs = j.filter(F.col("ended") > 0).select(
        "file", (F.col("sbefore") + F.col("before")).alias("o"),
        F.posexplode(F.concat(F.array(F.col("base") + F.col("first") - last - 1), "inner")).alias("i", "n_tokens"),
    ).select("file", (F.col("o") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = sup.groupBy("file").agg(F.max(F.col("base") + F.col("sn")).alias("n"), F.sum("sended").alias("ordinal"), F.max(F.col("base") + F.col("slast")).alias("last"))
    rest = rest.select("file", "ordinal", (F.col("n") - 1 - F.coalesce("last", F.lit(-1))).alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return docs.unionByName(rest)


def count_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", tokenizer: str | None = None, separator=SEPARATOR, width=WIDTH) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: write the documents' flat files, scan them, name the counts by the order written."""
    folder, order = write_stream(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, separator=separator, width=width)
    spark = docs.sparkSession
    if order.isEmpty():  # no task had rows, so there is no folder
        return spark.createDataFrame([], "doc_id long, file string, ordinal long, n_tokens long")
    files = list_files(spark, folder).join(order.select("file").distinct(), "file", "left_semi")
    return order.join(count_tokens(files, separator=separator, width=width).drop("ended"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
