"""An extension: how a group found in a table fares in a stream of rows like its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watch(stream: DataFrame, time: str, group: Column, target: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window of time: rows, rows of the group, their share, and the target's mean in and out of the group."""
    held = F.coalesce(group, F.lit(False))
    rows = stream.withWatermark(time, late).groupBy(F.window(time, every))
    y = F.col(target).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(held).alias("n_group"), F.avg(F.when(held, y)).alias("mean_group"), F.avg(F.when(~held, y)).alias("mean_rest")
    ).select(F.col("window.start").alias("start"), "n", "n_group", (F.col("n_group") / F.col("n")).alias("share"), "mean_group", "mean_rest")
