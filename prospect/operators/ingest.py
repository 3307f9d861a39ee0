"""Assembling entity tables: joins of parts, increments, series, roll-ups, derived columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.sources.scratch import cut


def assemble(parts: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Parts joined one after another on their common key."""
    return reduce(lambda a, b: a.join(b, key, how), parts)


def missing(new: DataFrame, stored: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet."""
    return new.join(stored, key, "left_anti")


def store(new: DataFrame, path: str, key: str | list[str]) -> None:
    """Append to a Parquet table what it does not have."""
    spark = new.sparkSession
    try:
        new = missing(new, spark.read.parquet(path), key)
    except Exception as e:  # the table's first rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def one_hot(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """A boolean column for each value (of a bounded number of them) in place of the column."""
    if values is None:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.select("*", *(F.coalesce(F.col(column) == v, F.lit(False)).alias(v) for v in values)).drop(column)


def series(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, times, values, length): each key's values by time, then value."""
    s = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(s.alias("s")).select(key, F.col("s.t").alias("times"), F.col("s.v").alias("values"), F.size("s").alias("length"))


def of_modal_length(found: DataFrame, length: str = "length") -> DataFrame:
    """The rows with the most frequent length; of several, the least."""
    counts = found.groupBy(length).agg(F.count(F.lit(1)).alias("c"))
    mode = counts.agg(F.min_by(length, F.struct(-F.col("c"), length)).alias(length))
    return found.join(F.broadcast(mode), length, "left_semi")


def log10(c: Column | str) -> Column:
    """log10, null at zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.log10(F.when(c != 0, c))


def days_since(c: Column | str, anchor: str) -> Column:
    return F.datediff(c, F.lit(anchor).cast("date"))


def low_pass(values, cutoff: float):
    """A series through a second-order Butterworth filter, forwards and backwards; cutoff as a share of the Nyquist rate."""
    import numpy as np

    k = np.tan(np.pi * cutoff / 2)
    q = 1 + np.sqrt(2) * k + k * k
    b, a = np.array([k * k, 2 * k * k, k * k]) / q, np.array([2 * (k * k - 1), 1 - np.sqrt(2) * k + k * k]) / q

    def once(x):
        y, x1, x2 = np.empty(len(x)), x[0], x[0]
        y1 = y2 = x[0]
        for i, v in enumerate(x):
            y[i] = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2 = v, x1, y[i], y1
        return y

    x = np.asarray(values, float)
    return once(once(x)[::-1])[::-1] if len(x) else x


def low_passed(df: DataFrame, column: str, cutoff: float, name: str = "smooth") -> DataFrame:
    """``df`` with each row's array through ``low_pass``; null stays null, a series without values is empty."""
    @F.pandas_udf("array<double>")
    def smooth(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else low_pass(v, cutoff).tolist())

    return df.withColumn(name, smooth(F.col(column).cast("array<double>")))


def scalar_target(df: DataFrame, target: str, how: str = "norm", param: float | int | str | None = None) -> DataFrame:
    """The array target as one number, in a column ``target`` + ``_`` + what it is, in place of it.

    ``component``: the entry at ``param`` (0); ``norm``: the ``param``-norm (2),
    1 or more, or infinite; ``centred-norm``: the same, less each component's mean;
    ``attribute``: another column, by name or position.
    """
    from .kernels import norm

    if how == "component":
        at = int(param or 0)
        return df.withColumn(f"{target}_{at}", F.get(target, F.lit(at))).drop(target)
    if how == "attribute":
        rest = [c for c in df.columns if c != target]
        name = param if isinstance(param, str) else rest[int(param or 0)]
        return df.drop(target).withColumn(name, F.col(name))
    p = float(2 if param is None else param)
    if how not in ("norm", "centred-norm") or p < 1:
        raise ValueError(f"no such target: {how} {p:g}")
    x = F.col(target)
    if how == "centred-norm":
        means = df.select(F.posexplode(target).alias("d", "v")).groupBy("d").agg(F.avg("v").alias("c"))
        centre = F.broadcast(means.agg(F.array_sort(F.collect_list(F.struct("d", "c")))["c"].alias("_centre")))  # a number for each component
        df = df.join(centre, F.lit(True))
        x = F.zip_with(x, "_centre", lambda a, b: a - b)
    return df.withColumn(f"{target}_{how}{p:g}", norm(x, p)).drop(target, "_centre")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to the given types; what does not convert is null, and no row fails."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items()})


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Columns from the fields of a JSON text; null where it is malformed or lacks them."""
    parsed = F.from_json(column, ", ".join(f"`{c}` {t}" for c, t in fields.items()))
    return df.withColumns({c: parsed[c] for c in fields})


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in the table's own order: each partition counts its rows, and starts after those before it.

    The table is written first, as it is read twice and its partitions must be the same both times.
    """
    at = cut(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return at.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_id")


def beside(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of several tables side by side, row by row in their own order; the shortest ends it."""
    out = numbered(left, "_at")
    for other in others:
        out = out.join(numbered(other, "_at"), "_at")
    return out.drop("_at")


def row_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` - 1 of the table's own order, with their place in ``orig_idx``."""
    return numbered(df, "orig_idx").where((F.col("orig_idx") >= start) & (F.col("orig_idx") < stop))


def with_labels(df: DataFrame, column: str) -> DataFrame:
    """``label``: the place of each row's value among the sorted distinct ones, and ``n``, how many rows have it."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    labels = numbered(counts.orderBy("_v"), "label")
    return df.join(labels, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")
