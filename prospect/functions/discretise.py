"""Cuts of numeric columns and the intervals that they make."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Flag, auto

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.operators.prefix import running
from prospect.sources.scratch import cut


class Ranges(Flag):
    INTERVALS = auto()
    SLABS_POSITIVE = auto()
    SLABS_NEGATIVE = auto()

    @classmethod
    def parse(cls, text: str) -> Ranges:
        out = cls(0)
        for part in filter(None, (x.strip().upper() for x in text.split("|"))):
            out |= cls[part]
        return out


@dataclass(frozen=True)
class Interval:
    """From ``lower`` to ``upper``; None is unbounded."""

    lower: float | None = None
    upper: float | None = None
    closed_below: bool = True
    closed_above: bool = False
    name: str = ""


def level_names(n: int) -> list[str]:
    """Names of up to five levels; more are numbered."""
    named = {1: ["all"], 2: ["low", "high"], 3: ["low", "med", "high"], 4: ["vlow", "low", "high", "vhigh"], 5: ["vlow", "low", "med", "high", "vhigh"]}
    return named.get(n) or [f"L:{i + 1}/{n}" for i in range(n)]


def entropy(counts: list[int], smooth: float = 1e-12) -> float:
    """Entropy in nats of the shares; an empty bin counts as a tiny share."""
    total = sum(counts)
    return -sum(p * math.log(p) for p in (max(c / total, smooth) for c in counts)) if total else 0.0


@dataclass(frozen=True)
class Discretiser:
    count: int = 3
    ranges: Ranges = Ranges.SLABS_POSITIVE

    def cuts(self, df: DataFrame, names: list[str]) -> dict[str, list[float]]:
        raise NotImplementedError

    def intervals(self, cuts: list[float]) -> list[Interval]:
        cuts = sorted(set(cuts))
        if not cuts:
            return []
        if len(cuts) == 1:  # below and above, whatever the ranges
            return [Interval(None, cuts[0], name="low"), Interval(cuts[0], None, name="high")]
        out: list[Interval] = []
        if Ranges.INTERVALS in self.ranges:
            edges = [None, *cuts, None]
            out += [Interval(a, b, name=n) for a, b, n in zip(edges, edges[1:], level_names(len(cuts) + 1))]
        if Ranges.SLABS_POSITIVE in self.ranges:
            out += [Interval(c, None, name=f"ge:{i + 1}/{len(cuts)}") for i, c in enumerate(cuts)]
        if Ranges.SLABS_NEGATIVE in self.ranges:
            out += [Interval(None, c, closed_above=True, name=f"le:{i + 1}/{len(cuts)}") for i, c in enumerate(cuts)]
        return out


def finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


@dataclass(frozen=True)
class Frequency(Discretiser):
    """Cuts at distinct values so that the bins hold about equally many rows: exact discrete quantiles.

    At most one cut fewer than there are distinct values; the least value is no cut.
    """

    midpoints: bool = False

    def cuts(self, df: DataFrame, names: list[str]) -> dict[str, list[float]]:
        if not names:
            return {}
        cols = df.select(*(finite(n).alias(n) for n in names))
        rows = cols.agg(*(F.array(*(F.expr(f"percentile_disc({(i + 1) / (self.count + 1)}) WITHIN GROUP (ORDER BY `{n}`)") for i in range(self.count))).alias(n) for n in names), *(F.min(n).alias(f"_min_{i}") for i, n in enumerate(names))).first()
        out = {n: sorted({v for v in rows[n] if v is not None and v > rows[f"_min_{i}"]}) for i, n in enumerate(names)}
        if self.midpoints:
            below = {n: [F.max(F.when(F.col(n) < c, F.col(n))).alias(f"{i}_{j}") for j, c in enumerate(out[n])] for i, n in enumerate(names)}
            if any(below.values()):
                got = cols.agg(*(c for cs in below.values() for c in cs)).first()
                out = {n: [(c + got[f"{i}_{j}"]) / 2 for j, c in enumerate(out[n])] for i, n in enumerate(names)}
        return out


#: A cut of greatest entropy is sought among the values at which the share of rows below passes a multiple of one in so many.
PLACES = 4096


@dataclass(frozen=True)
class Entropy(Discretiser):
    """Cuts at distinct values so that the entropy of the bins is greatest, of all choices of that many cuts.

    Where values have heavy ties that differs from quantiles. Running sums over the distinct
    values, by ranges, give the share of rows below each; a dynamic program for each
    column goes over those that pass another of ``PLACES`` equal shares, which are all with up to that many rows, so no
    column's values meet in one task. At most one cut fewer than there are distinct values; the least value is no cut.
    """

    def cuts(self, df: DataFrame, names: list[str]) -> dict[str, list[float]]:
        if not names:
            return {}
        each = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), finite(n).alias("v")) for i, n in enumerate(names)))).alias("x"))
        values = each.select("x.i", "x.v").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
        run = running(values, ["i"], ["v"], {"to": F.col("c")})
        totals = cut(run.groupBy("i").agg(F.sum("c").alias("all")), "totals")
        below = run.join(F.broadcast(totals), "i").withColumn("below", F.col("to") - F.col("c"))  # a row a column
        places = below.where("below > 0").groupBy("i", "all", F.floor(F.col("below") * PLACES / F.col("all")).alias("place")).agg(F.min_by(F.struct("v", "below"), "below").alias("at"))
        rows = places.select("i", (F.col("at.below") / F.col("all")).alias("share"), "at.v")
        count = self.count

        def best(of: pd.DataFrame) -> pd.DataFrame:
            return _best_cuts(count, of)

        found = rows.groupBy("i").applyInPandas(best, "i int, v double").collect()  # the cuts
        return {n: sorted(r["v"] for r in found if r["i"] == i) for i, n in enumerate(names)}


def _best_cuts(count: int, rows: pd.DataFrame) -> pd.DataFrame:
    """The cuts of greatest entropy among the values, each with the share of rows below it; of equal ones the lower."""
    rows = rows.sort_values("share")
    share, k = np.append(0.0, rows["share"].to_numpy()), min(count, len(rows))

    def part(p):
        return -p * np.log(np.where(p > 0, p, 1.0))

    best, back = np.where(np.arange(len(share)) == 0, 0.0, -np.inf), []
    for _ in range(k):
        new, came = np.full(len(share), -np.inf), np.zeros(len(share), np.int64)
        for j in range(1, len(share)):
            tried = best[:j] + part(share[j] - share[:j])
            came[j] = int(np.argmax(tried))
            new[j] = tried[came[j]]
        best = new
        back.append(came)
    at, chosen = int(np.argmax(best + part(1.0 - share))), []
    for came in reversed(back):
        chosen.append(at)
        at = came[at]
    return pd.DataFrame({"i": int(rows["i"].iloc[0]), "v": rows["v"].to_numpy()[np.array(chosen[::-1], int) - 1]})


@dataclass(frozen=True)
class Uniform(Discretiser):
    """Cuts at equal widths between the finite extremes."""

    def cuts(self, df: DataFrame, names: list[str]) -> dict[str, list[float]]:
        if not names:
            return {}
        row = df.agg(*(f(finite(n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("a", F.min), ("b", F.max)))).first()
        out = {}
        for i, n in enumerate(names):
            a, b = row[f"a_{i}"], row[f"b_{i}"]
            out[n] = [] if a is None or a == b else [a + (b - a) * (j + 1) / (self.count + 1) for j in range(self.count)]
        return out


@dataclass(frozen=True)
class Fixed(Discretiser):
    """Given cuts, by column; ``given`` is a tuple of (column, cuts)."""

    given: tuple[tuple[str, tuple[float, ...]], ...] = field(default=())

    def cuts(self, df: DataFrame, names: list[str]) -> dict[str, list[float]]:
        known = dict(self.given)
        return {n: list(known.get(n, ())) for n in names}


def bin_counts(df: DataFrame, name: str, cuts: list[float]) -> DataFrame:
    """(bin, n): rows by the number of cuts at or below their value."""
    value = finite(name)
    which = sum(((value >= c).cast("int") for c in cuts), F.lit(0))
    return df.where(value.isNotNull()).groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
