"""Readers of attribute tables, graphs and kernels from text and binary files."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospect.operators.ingest import numbered

DATASETS: dict[str, Callable[..., DataFrame]] = {}


def dataset(name: str):
    """Register a loader under a name."""

    def keep(f):
        if name in DATASETS:
            raise ValueError(f"dataset {name!r} is there already")
        DATASETS[name] = f
        return f

    return keep


def parse_call(text: str) -> tuple[str, list[str], dict[str, str]]:
    """``name:a,b=c`` with quotes around what holds a comma: a name, positional and named arguments."""
    name, _, rest = text.partition(":")
    args, named = [], {}
    for quoted, plain in re.findall(r'((?:\w+=)?"(?:[^"\\]|\\.)*")|([^,"]+)', rest):
        item = (quoted or plain).strip()
        key, eq, value = item.partition("=")
        if eq and re.fullmatch(r"\w+", key):
            named[key] = value.strip('"').replace('\\"', '"')
        elif item:
            args.append(item.strip('"').replace('\\"', '"'))
    return name.strip(), args, named


def load(spark: SparkSession, text: str) -> DataFrame:
    from . import texts  # noqa: F401  (registers its loaders)

    name, args, named = parse_call(text)
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    return DATASETS[name](spark, *args, **named)


@dataset("points")
def points(spark: SparkSession, path: str, kind: str = "boolean", labels: str = "") -> DataFrame:
    """A file of x, y and label, separated by spaces: a position, and the label as booleans or as it is."""
    df = spark.read.csv(path, sep=" ", header=True, schema="x double, y double, label string")
    df = df.select(F.array("x", "y").alias("position"), "label")
    if kind == "categorical":
        return df
    names = labels.split("|") if labels else [r[0] for r in df.select("label").distinct().orderBy("label").collect()]
    return df.select(*(F.coalesce(F.col("label") == n, F.lit(False)).alias(n) for n in names), "position")


@dataset("csv")
def csv(spark: SparkSession, path: str, null: str = "?", schema: str = "") -> DataFrame:
    reader = spark.read.option("header", True).option("nullValue", null)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


_ATTRIBUTE = re.compile(r"@attribute\s+(\S+)\s*(?:(real|integer)\b|(\{))", re.I)


@dataset("keel")
def keel(spark: SparkSession, path: str) -> DataFrame:
    """A file of @-declarations, then comma-separated data; every data row counts, and a cell that isn't of its column's type is null."""
    lines = spark.read.text(path)
    header = [r[0] for r in lines.where(F.col("value").startswith("@")).collect()]  # declarations, one for each column
    fields = []
    for line in header:
        if m := _ATTRIBUTE.match(line.strip()):
            fields.append((m[1], "double" if (m[2] or "").lower() == "real" else "long" if m[2] else "string"))
    data = lines.where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    cells = F.split("value", r"\s*,\s*")
    missing = lambda c: F.when(~c.isin("?", "<null>"), c)
    return data.select(*(missing(F.trim(F.get(cells, F.lit(i)))).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path), "line")


def _if_there(df):
    """What ``df()`` reads, None if there is no such file."""
    try:
        return df()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def graphs(spark: SparkSession, folder: str, name: str, both_ways: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A set of graphs from ``name_A``, ``_graph_indicator``, ``_graph_labels`` and, if there, labels and attributes of nodes and edges.

    Returns vertices (graph, vid, label), edges (graph, src, dst) and graphs (graph, target); vertices
    are numbered from 0 within their graph, with null labels if there is no file of them. Where there
    are attributes of vertices, labels or attributes of edges, they are columns too; of an edge that
    stands in both directions ``both_ways`` keeps the least.
    """
    base = f"{folder.rstrip('/')}/{name}"

    def column(suffix: str, as_name: str, value) -> DataFrame | None:
        return _if_there(lambda: _numbered(spark, f"{base}_{suffix}.txt").select((F.col("line") + 1).alias("node"), value.alias(as_name)))

    whole, list_ = F.trim("value").cast("int"), F.transform(F.split("value", r"\s*,\s*"), lambda x: F.trim(x).try_cast("double"))

    def with_columns(rows: DataFrame, of: str) -> DataFrame:
        for suffix, as_name, value in ((f"{of}_labels", "label", whole), (f"{of}_attributes", "attributes", list_)):
            more = column(suffix, as_name, value)
            rows = rows if more is None else rows.join(more, "node", "left")
        return rows

    of = column("graph_indicator", "graph", F.trim("value").cast("long"))
    first = of.groupBy("graph").agg(F.min("node").alias("first"))
    of = of.join(first, "graph").select("node", "graph", (F.col("node") - F.col("first")).alias("vid"))
    vertices = with_columns(of, "node")
    if "label" not in vertices.columns:
        vertices = vertices.withColumn("label", F.lit(None).cast("int"))
    vertices = vertices.select("graph", "vid", "label", *(c for c in vertices.columns if c == "attributes"))
    ends = F.split("value", r"\s*,\s*")
    edges = _numbered(spark, f"{base}_A.txt").where(F.trim("value") != "").select((F.col("line") + 1).alias("node"), F.trim(ends[0]).cast("long").alias("a"), F.trim(ends[1]).cast("long").alias("b"))
    left, right = of.select(F.col("node").alias("a"), "graph", F.col("vid").alias("src")), of.select(F.col("node").alias("b"), F.col("vid").alias("dst"))
    edges = with_columns(edges, "edge")
    more = [c for c in edges.columns if c in ("label", "attributes")]
    edges = edges.join(left, "a").join(right, "b").select("graph", "src", "dst", *more)
    if both_ways:
        back = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), *more)
        edges = edges.unionByName(back).groupBy("graph", "src", "dst").agg(*(F.min(c).alias(c) for c in more)) if more else edges.unionByName(back).distinct()
    targets = column("graph_labels", "target", whole).select(F.col("node").alias("graph"), "target")
    return vertices, edges, targets


def unpack_kernel(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and symmetric matrix from a packed upper triangle: big-endian count, little-endian 64-bit ids, a byte for each entry."""
    n = struct.unpack(">I", blob[:4])[0]
    ids = np.frombuffer(blob, "<u8", n, 4)
    k = np.zeros((n, n), np.uint8)
    k[np.triu_indices(n)] = np.frombuffer(blob, np.uint8, n * (n + 1) // 2, 4 + 8 * n)
    return ids, np.maximum(k, k.T)


def columns_of(text: str) -> list[tuple[int, int, str]]:
    """(column, row, value) of a small text payload: dense columns ``v, v, ...`` or sparse ``i:v, a-b:v, ...``, one a line.

    Indices and ranges count from 1; ``?`` is missing.
    """
    out = []
    for c, line in enumerate(x for x in text.splitlines() if x.strip()):
        for r, cell in enumerate(x.strip() for x in line.split(",")):
            if m := re.fullmatch(r"(\d+)(?:-(\d+))?\s*:\s*(.*)", cell):
                out += [(c, i - 1, m[3]) for i in range(int(m[1]), int(m[2] or m[1]) + 1) if m[3] != "?"]
            elif cell != "?":
                out.append((c, r, cell))
    return out
