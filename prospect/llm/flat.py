"""Flat files in the shared folder, written and read in ranges by tasks.

Each task writes files of its own under fresh names and returns them as rows;
only files named in rows that were kept count, so a lost or repeated task leaves
at most a file that nobody reads.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of files that a task reads, where there are more than a few for each core.
TASK_BYTES = 64 << 20


def dealt(rows: DataFrame, files: DataFrame, block: int, *keys: str) -> DataFrame:
    """Rows that stand for blocks of ``files`` (file, bytes), dealt to tasks by the bytes that they will read.

    Spark would gather them by their own few bytes instead.
    """
    blocks, size = files.agg(F.sum(F.ceil(F.col("bytes") / block)), F.sum("bytes")).first()
    tasks = min(blocks or 1, max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES)))
    return rows.repartition(int(tasks), F.xxhash64(*keys))


def create(folder: str, suffix: str):
    """A new file: its address and a stream to write."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")


def open_file(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
