"""Matrices and relations as text: @-declarations, then a payload of one line a column or row.

A payload's line is ``index v,v,...`` or, sparse, ``index (i,j,a-b) v,v,...``;
indices and ranges count from 1, ``?`` is missing, and an index may be left out
where the lines are dense (their order counts then). Declarations are few and read on the
driver; payload lines are parsed by columns' functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospect.operators.ingest import numbered

from .readers import dataset

#: The kinds of attributes, and how their cells are read.
KINDS = {"nominal": "long", "numeric": "double", "categorical": "string", "boolean": "boolean", "index": "long", "string": "string"}
STORAGE = {"int": "long", "float": "double"}
MISSING = "?"


def _declared(lines: DataFrame) -> list[str]:
    return [r[0].strip() for r in lines.where(F.ltrim("value").startswith("@")).orderBy("line").collect()]  # declarations


def _properties(header: list[str]) -> dict[str, str]:
    data = next((h for h in header if re.match(r"@data\b", h, re.I)), "")
    return {k.lower(): v.lower() for k, v in re.findall(r"(\w+)=(\S+)", data)}


def ranges(text: Column) -> Column:
    """``1,4-6`` as an array of numbers from 0."""
    ends = lambda part: F.split(part, "-")
    each = lambda part: F.sequence(F.get(ends(part), F.lit(0)).cast("long") - 1, F.element_at(ends(part), -1).cast("long") - 1)
    return F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), each))


def _payload(lines: DataFrame) -> DataFrame:
    """(line, at, values, places): a payload line's index, its cells as text, and their places, from 0."""
    body = lines.where(~F.ltrim("value").startswith("@") & (F.trim("value") != "")).withColumn("value", F.trim("value"))
    sparse = F.regexp_extract("value", r"^(\d+)\s*\(([^)]*)\)\s*(.*)$", 2)
    is_sparse, indexed = F.col("value").rlike(r"^\d+\s*\("), F.col("value").rlike(r"^\d+\s+\S")
    cells = F.when(is_sparse, F.regexp_extract("value", r"^(\d+)\s*\(([^)]*)\)\s*(.*)$", 3)).when(indexed, F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2)).otherwise(F.col("value"))
    values = F.transform(F.split(cells, ","), lambda c: F.when(F.trim(c) != MISSING, F.trim(c)))
    at = F.when(is_sparse | indexed, F.regexp_extract("value", r"^(\d+)", 1).cast("long") - 1)
    return body.select("line", at.alias("at"), values.alias("values"), F.when(is_sparse, F.when(sparse == "", F.array().cast("array<long>")).otherwise(ranges(sparse))).alias("places"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path), "line")


def _cells(lines: DataFrame, by_rows: bool) -> DataFrame:
    """(i, j, cell): rows, columns and cells of a payload."""
    body = _payload(lines)
    first = lines.where(F.lower(F.ltrim("value")).rlike(r"^@data\b")).agg((F.min("line") + 1).alias("first"))  # one row
    body = body.join(F.broadcast(first), F.lit(True)).withColumn("at", F.coalesce("at", F.col("line") - F.coalesce("first", F.lit(0))))
    places = F.coalesce("places", F.sequence(F.lit(0).cast("long"), F.size("values").cast("long") - 1))
    cells = body.select("at", F.explode(F.arrays_zip(places.alias("place"), F.col("values").alias("cell"))).alias("c")).select("at", "c.place", "c.cell")
    i, j = ("at", "place") if by_rows else ("place", "at")
    return cells.select(F.col(i).alias("i"), F.col(j).alias("j"), "cell")


@dataset("matrix")
def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a matrix file, from 0; a missing cell has a null value, a sparse file only its own cells."""
    lines = _lines(spark, path)
    cells = _cells(lines, _properties(_declared(lines)).get("order", "columns") == "rows")
    return cells.select("i", "j", F.col("cell").try_cast("double").alias("v"))


@dataset("relation")
def relation(spark: SparkSession, path: str) -> DataFrame:
    """A relation file's rows, with a column for each declared one; cells that do not convert are null."""
    lines = _lines(spark, path)
    header = _declared(lines)
    names = next((re.findall(r'"[^"]*"|\S+', h)[1:] for h in header if re.match(r"@columns\b", h, re.I)), [])
    types = ["string"] * len(names)
    for h in header:
        if m := re.match(r"@attribute\s+\(?([\d,\-\s]+?)\)?\s+(\w+)(.*)$", h, re.I):
            kind = STORAGE.get(dict(re.findall(r"(\w+)=(\S+)", m[3])).get("storage", ""), KINDS[m[2].lower()])
            for part in filter(None, re.sub(r"\s", "", m[1]).split(",")):
                low, _, high = part.partition("-")
                for i in range(int(low) - 1, int(high or low)):
                    types[i] = kind
    names = [n.strip('"') for n in names]
    if _properties(header).get("order", "columns") == "rows":
        body = _payload(lines).withColumn("values", F.when(F.col("places").isNull(), F.col("values")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda k: F.try_element_at(F.map_from_arrays(F.coalesce("places", F.array().cast("array<long>")), F.when(F.col("places").isNotNull(), F.col("values")).otherwise(F.array().cast("array<string>"))), k.cast("long") - 1))))
        return body.select(*(F.get("values", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, types))))
    rows = _cells(lines, False).groupBy("i").agg(*(F.max(F.when(F.col("j") == k, F.col("cell"))).alias(n) for k, n in enumerate(names)))
    return rows.select(*(F.col(f"`{n}`").try_cast(t).alias(n) for n, t in zip(names, types)))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def _written(lines: DataFrame, head: list[str], tail: list[str], path: str) -> None:
    """Lines (at, value) between declarations, in order over the folder's files."""
    spark = lines.sparkSession
    ends = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)] + [(2**62 + i, t) for i, t in enumerate(tail)], "at long, value string")
    lines.unionByName(ends).orderBy("at").select("value").write.text(path)


def write_matrix(entries: DataFrame, path: str, name: str, sparse: bool = True) -> None:
    """Entries (i, j, v), counted from 0, as a matrix file by columns.

    Runs of neighbouring rows become ranges. A dense file's columns end at the
    last row of any, and cells that are not there are 0. A column is a line of
    the format, so it is one row of the job.
    """
    e = entries.select(F.col("i").cast("long"), F.col("j").cast("long"), "v")
    if sparse:
        run = F.col("i") - F.row_number().over(Window.partitionBy("j").orderBy("i"))
        runs = e.withColumn("run", run).groupBy("j", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.sort_array(F.collect_list(F.struct("i", _text(F.col("v")).alias("v")))).alias("c"))
        part = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("a") + 1, F.col("b") + 1))
        whole = runs.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("a", part.alias("p"), F.col("c.v").alias("v")))).alias("r"))
        line = F.concat(F.col("j") + 1, F.lit(" ("), F.array_join("r.p", ","), F.lit(") "), F.array_join(F.flatten("r.v"), ","))
        lines = whole.select(F.col("j").alias("at"), line.alias("value"))
    else:
        last = F.broadcast(e.agg(F.max("i").alias("last")))  # one row
        columns = e.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("i", _text(F.col("v")).alias("v")))).alias("m")).join(last, F.lit(True))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("0")))
        lines = columns.select(F.col("j").alias("at"), F.concat((F.col("j") + 1).cast("string"), F.lit(" "), F.array_join(cells, ",")).alias("value"))
    _written(lines, [f"@matrix {name}", f"@data type={'sparse' if sparse else 'dense'} order=columns"], ["@end data", f"@end matrix {name}"], path)


def write_relation(df: DataFrame, path: str, name: str) -> None:
    """A table of numbers, booleans and texts without commas as a relation file, by rows: a column as one line would not scale."""
    kinds = {"string": "string", "boolean": "boolean"}
    attributes = [f"@attribute ({i + 1}) " + (kinds.get(t) or ("numeric storage=float" if t in ("double", "float") else "numeric storage=int")) for i, (_, t) in enumerate(df.dtypes)]
    cells = F.concat_ws(",", *(_text(F.col(f"`{c}`")) for c in df.columns))
    lines = numbered(df.select(cells.alias("cells")), "at").select("at", F.concat((F.col("at") + 1).cast("string"), F.lit(" "), F.col("cells")).alias("value"))
    columns = " ".join(f'"{c}"' if re.search(r"\s", c) else c for c in df.columns)
    _written(lines, [f"@relation {name}", f"@columns {columns}", *attributes, "@data type=dense order=rows"], ["@end data", f"@end relation {name}"], path)


@dataset("packed-kernels")
def packed_kernels(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k), i <= j by place: the entries of all packed kernel files, a file to a task at most."""
    import pandas as pd

    from .readers import unpack_kernel

    def run(batches):
        import numpy as np

        for batch in batches:
            for where, blob in zip(batch["path"], batch["content"]):
                ids, k = unpack_kernel(blob)
                a, b = np.triu_indices(len(ids))
                yield pd.DataFrame({"path": where, "i": ids[a].astype("int64"), "j": ids[b].astype("int64"), "k": k[a, b].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, j long, k double")


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(line, pattern): the ``{a^b}`` descriptions in a text, in order; several on one line are several rows."""
    return _lines(spark, path).select("line", F.posexplode(F.regexp_extract_all("value", F.lit(r"(\{[^{}]*\})"))).alias("at", "pattern")).orderBy("line", "at").select("line", "pattern")
