"""Token counts of the documents in flat token files that have no index.

A file holds unsigned 16-bit ids (little-endian), documents one after another,
each ended by an identifier that no text encodes to. The scan splits files into
blocks of fixed size; a task finds all separators of its block by one vectorised
comparison; a prefix scan over the blocks of a file (separators so far, last
separator so far) tells where the first document of each block began. Ids that
follow a file's last separator are a document that is not ended.

``write`` makes such files of a table, for tests and for the query.

Edge cases: a null or empty text is a document of no ids; repeated rows are
documents of their own; a very long text is written and counted whole, across
blocks; empty files and tables give no rows; rows without an id are counted as
others. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, scratch_path
from .flat import create, dealt, open_file
from .packing import RANKS, Encoder

#: The separator, and bytes of a block (a whole number of ids).
END, BLOCK = 50256, 8 << 20


def _write(folder: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, ids, size, uri, kind = Encoder.of_ranks(ranks), None, [], 0, "", pa.int64()
        for batch, texts in chunks(batches):
            if out is None:
                uri, out = create(folder, ".bin")
                kind = batch.schema.field("doc_id").type
            for text in texts:
                found = np.array(enc.ids(text) + [END], "<u2").tobytes()
                size += len(found)
                out.write(found)
            ids += batch.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            for at in range(0, len(ids), 50_000):
                part = ids[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part)), pa.array([size] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part))), pa.array(part, kind)], ["file", "bytes", "ordinal", "doc_id"])

    return run


def write(docs: DataFrame, folder: str | None = None, ranks: str | None = None) -> DataFrame:
    """Flat files of the texts' ids. Returns (file, bytes, ordinal, doc_id): which document stands where."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    ranks = ranks or public_tokenizers.path(RANKS)
    docs = docs.select("doc_id", "text")
    return cut(docs.mapInArrow(_write(folder, ranks), f"file string, bytes long, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}"), "written")


def _separators(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "at", "size"))):
                with open_file(file) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(size), "<u2")
                found = at // 2 + np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([at // 2 + len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "stop", "ends"]
                )

    return run


def scan(files: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in the files (file, bytes)."""
    block -= block % 2
    blocks = files.where("bytes >= 2").select("file", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(block))).alias("at"), "bytes")
    blocks = blocks.select("file", (F.col("at") / block).cast("long").alias("block"), "at", F.least(F.lit(block), F.col("bytes") - F.col("at")).alias("size"))
    found = dealt(blocks, files, block, "file", "block").mapInArrow(_separators(end), "file string, block long, stop long, ends array<long>")
    found = found.withColumn("n", F.size("ends")).withColumn("last", F.try_element_at("ends", F.lit(-1)))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("begun", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    found = found.withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    rows = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), F.when(i > 0, F.get("ends", i - 1) + 1).otherwise(F.col("begun")).alias("start"), e.alias("stop"), F.lit(True).alias("ended")))
    open_from = F.coalesce(F.col("last") + 1, F.col("begun"))
    tail = F.when(F.col("final") & (F.col("stop") > open_from), F.array(F.struct((F.col("first") + F.col("n")).alias("ordinal"), open_from.alias("start"), F.col("stop").alias("stop"), F.lit(False).alias("ended"))))
    whole = F.concat(rows, F.coalesce(tail, F.array().cast("array<struct<ordinal:long,start:long,stop:long,ended:boolean>>")))
    return found.select("file", F.explode(whole).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), "d.ended")


def count(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the counts that a scan of the documents' flat files finds."""
    written = write(docs)
    files = cut(written.groupBy("file").agg(F.max("bytes").alias("bytes")), "files")
    # a row for each document on both sides: never a broadcast
    return scan(files).hint("merge").join(written.select("file", "ordinal", "doc_id"), ["file", "ordinal"]).select("doc_id", "n_tokens")
