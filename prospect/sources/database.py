"""Tables of SQLite databases, read by ranges of a key, with columns and filters that the database itself applies.

A database is a file, or a folder of files that hold parts of the same tables, by a path that
driver and executors can open. Each partition of a scan is a range of the key in
one file and runs its own SELECT; a task sends rows on in batches of ``BATCH``.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

BATCH = 10_000
#: What declared column types are read as.
TYPES = {"INT": LongType(), "INTEGER": LongType(), "BIGINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "BLOB": BinaryType()}
_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob(os.path.join(path, "*.db"))) if os.path.isdir(path) else [path]


def condition(filter_: Filter, known: set[str]) -> tuple[str, list] | None:
    """A filter as SQL with its parameters; None if the database would not mean the same by it."""
    if isinstance(filter_, Not):
        found = condition(filter_.child, known)
        return found and (f"NOT ({found[0]})", found[1])
    name = getattr(filter_, "attribute", None)
    if name is None or len(name) != 1 or name[0] not in known:
        return None
    column = _quoted(name[0])
    if isinstance(filter_, (IsNull, IsNotNull)):
        return f"{column} IS {'NOT ' if isinstance(filter_, IsNotNull) else ''}NULL", []
    plain = lambda v: type(v) in (int, str) or (type(v) is float and v == v)
    if isinstance(filter_, In):
        values = list(filter_.value)
        return (f"{column} IN ({', '.join('?' * len(values))})", values) if values and all(map(plain, values)) else None
    if type(filter_) in _COMPARED and plain(filter_.value):
        return f"{column} {_COMPARED[type(filter_)]} ?", [filter_.value]
    return None


@dataclass
class KeyRange(InputPartition):
    """Keys from ``start`` to before ``stop`` in one file; None is unbounded, both None are rows without a key."""

    file: str
    start: int | None
    stop: int | None

    def where(self, key: str) -> tuple[str, list]:
        column = _quoted(key)
        if self.start is None and self.stop is None:
            return f"{column} IS NULL", []
        parts = [(f"{column} >= ?", self.start), (f"{column} < ?", self.stop)]
        return " AND ".join(p for p, v in parts if v is not None), [v for _, v in parts if v is not None]


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key, self.n = options["path"], options["table"], options["key"], int(options.get("partitions", 8))
        self.schema, self.filters = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = set(self.schema.names)
        for f in filters:
            if (found := condition(f, known)) is None:
                yield f
            else:
                self.filters.append(found)

    def partitions(self) -> list[KeyRange]:
        """Even ranges of the keys that the filters leave, in each file."""
        out, where = [], " AND ".join(["1", *(c for c, _ in self.filters)])
        given = [v for _, values in self.filters for v in values]
        for file in files(self.path):
            with _open(file) as db:
                low, high, n, none = db.execute(f"SELECT min({_quoted(self.key)}), max({_quoted(self.key)}), count(*), count(*) - count({_quoted(self.key)}) FROM {_quoted(self.table)} WHERE {where}", given).fetchone()
            if none:
                out.append(KeyRange(file, None, None))
            if n > none:
                step = max(1, -(-(high - low + 1) // self.n))
                starts = list(range(low, high + 1, step))
                out += [KeyRange(file, a, a + step) for a in starts]
        return out or [KeyRange("", None, None)]

    def select(self, part: KeyRange) -> tuple[str, list]:
        conditions = [part.where(self.key), *self.filters]
        return f"SELECT {', '.join(map(_quoted, self.schema.names))} FROM {_quoted(self.table)} WHERE {' AND '.join(f'({c})' for c, _ in conditions)}", [v for _, values in conditions for v in values]

    def read(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        kinds = [{LongType: pa.int64(), DoubleType: pa.float64(), BinaryType: pa.binary()}.get(type(f.dataType), pa.string()) for f in self.schema]
        with _open(part.file) as db:
            found = db.execute(*self.select(part))
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], self.schema.names)


class Tables(DataSource):
    """Options: path, table, key (a column of whole numbers), columns (all), partitions a file (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(files(self.options["path"])[0]) as db:
            known = {r[1]: r[2].upper() for r in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")}
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or list(known)
        return StructType([StructField(c, TYPES.get(known[c], StringType())) for c in wanted])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)


def scan(spark: SparkSession, path: str, table: str, key: str, columns: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """A table's columns; what follows as ``where`` with plain comparisons is left to the database."""
    spark.dataSource.register(Tables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("key", key).option("partitions", partitions)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def tables(path: str) -> list[str]:
    """The names of a database's tables."""
    with _open(files(path)[0]) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def export(df: DataFrame, folder: str, table: str, key: str) -> int:
    """Write ``df`` as a folder of databases with the same table, one a task, indexed by ``key``. Returns the number of rows.

    A task writes a file of its own and moves it to its place when it is whole, so one that runs again replaces its file.
    """
    path = folder.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    names = df.columns
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    declared = ", ".join(f"{_quoted(c)} {kinds.get(t, 'TEXT')}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        with tempfile.TemporaryDirectory(dir=path) as own:
            with sqlite3.connect(f"{own}/part.db") as db:
                db.execute(f"CREATE TABLE {_quoted(table)} ({declared})")
                for batch in batches:
                    db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns)))
                    n += batch.num_rows
                db.execute(f"CREATE INDEX {_quoted(f'{table}_{key}')} ON {_quoted(table)} ({_quoted(key)})")
            db.close()
            os.replace(f"{own}/part.db", f"{path}/part-{part:05d}.db")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
