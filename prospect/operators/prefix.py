"""Running sums within groups of any size.

A window over a group is one task. Here rows are dealt out by ranges of group and
order instead; each range sums up its own, the ranges' totals say what came before,
and a join adds it. A group that holds most rows is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.sources.scratch import cut


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums, this row's included, within ``group`` by ``order`` (ascending; it should have no ties).

    The ranges are written before they are used twice, as what they are is sampled.
    Groups must not be null.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(n, *group, *order).withColumn("_span", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*group, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({k: F.sum(f"_{k}").over(within) for k in sums})
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_span").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    starts = totals.select(*group, "_span", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in sums))
    return own.join(starts, [*group, "_span"]).withColumns({k: F.col(k) + F.col(f"_start_{k}") for k in sums}).drop("_span", *(f"_{k}" for k in sums), *(f"_start_{k}" for k in sums))
