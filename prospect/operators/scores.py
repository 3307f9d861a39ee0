"""Measures of a group of rows, and bounds on what any subset of it can reach.

A score is a formula over sums and extremes of per-row values, so it is computed
from rows that were added up by signature beforehand. ``parts`` gives the per-row
values with the way they add up, ``value`` the formula over a group's columns;
``n`` is always there. Rows whose target is null are in no group: they were not
measured, so they count neither as members nor among all.
"""

from __future__ import annotations

import re
from ast import literal_eval
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import moments
from .prefix import running


def _ratio(a: Column, b: Column | float) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def measured(df: DataFrame, target: str | None) -> DataFrame:
    """The rows that have a target."""
    return df if target is None else df.where(F.col(target).isNotNull())


@dataclass(frozen=True)
class Totals:
    """What holds for all rows: their number, the target's mean, and how many hold if it is boolean."""

    n: int
    mean: float = 0.0
    held: int = 0
    means: tuple[float, ...] = ()
    edges: int = 0

    @classmethod
    def of(cls, df: DataFrame, target: str | None) -> Totals:
        if target is None:
            return cls(df.count())
        df = measured(df, target)
        if dict(df.dtypes)[target].startswith("array"):
            size = df.agg(F.max(F.size(target))).first()[0] or 0
            r = df.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.get(target, F.lit(i))) for i in range(size))).alias("m")).first()
            return cls(r["n"], means=tuple(r["m"] or ()))
        y = F.col(target).cast("double")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.count_if(y != 0).alias("h")).first()
        return cls(r["n"], r["m"] or 0.0, r["h"])


@dataclass(frozen=True)
class Score:
    """``parts(totals)``: name -> (per-row value, "sum" or "max"); ``value(totals)``: formula over those names and n.

    ``derived(totals)`` replaces parts of a signature's rows by values of their sums, before they are added up any further.
    Scores of graphs name the ``columns`` of vertices that they need (``degree``, ``core``), and whether they need the
    coreness within the group (``shells``); then ``outer`` is what no subset's score exceeds, from sums alone.
    """

    target: str | None = None
    columns: ClassVar[tuple[str, ...]] = ()
    shells: ClassVar[bool] = False

    def outer(self, totals: Totals) -> Column:
        return F.lit(float("inf"))

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {}

    def derived(self, totals: Totals) -> dict[str, Column]:
        return {}

    def value(self, totals: Totals) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Constant(Score):
    """A bound that prunes nothing, unless a value is given."""

    given: float = float("inf")

    def value(self, totals: Totals) -> Column:
        return F.lit(float(self.given))


@dataclass(frozen=True)
class Coverage(Score):
    """The share of rows; its own bound."""

    def value(self, totals: Totals) -> Column:
        return _ratio(F.col("n").cast("double"), totals.n)


@dataclass(frozen=True)
class Jaccard(Score):
    """Agreement with a boolean target: both over either; 0 where both are empty."""

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"both": (F.col(self.target).cast("int").cast("long"), "sum")}

    def value(self, totals: Totals) -> Column:
        return _ratio(F.col("both").cast("double"), F.col("n") + F.lit(totals.held) - F.col("both"))


@dataclass(frozen=True)
class JaccardBound(Jaccard):
    def value(self, totals: Totals) -> Column:
        return _ratio(F.col("both").cast("double"), totals.held)


@dataclass(frozen=True)
class MeanShift(Score):
    """Coverage and upward shift of the mean: (m/n)^a * max(mean - mean of all, 0)^b, a = e/max(e, 1), b = 1/max(e, 1)."""

    exponent: float = 1.0

    @property
    def powers(self) -> tuple[float, float]:
        return self.exponent / max(self.exponent, 1.0), 1.0 / max(self.exponent, 1.0)

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"shift": (F.col(self.target).cast("double") - F.lit(totals.mean), "sum")}

    def value(self, totals: Totals) -> Column:
        a, b = self.powers
        return F.pow(_ratio(F.col("n").cast("double"), totals.n), F.lit(a)) * F.pow(F.greatest(_ratio(F.col("shift"), F.col("n")), F.lit(0.0)), F.lit(b))


@dataclass(frozen=True)
class MeanShiftBound(MeanShift):
    """No subset's score is higher.

    With exponent 1 it is exact: the score is the sum of deviations over n, so
    the best subset has the positive ones. Otherwise a subset of size s has a
    shift of at most the greatest deviation (``top``) and of the sum of positive
    ones over s; the score with the lesser of both is greatest where they meet,
    or, if coverage weighs more, at the whole group.
    """

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        d = F.col(self.target).cast("double") - F.lit(totals.mean)
        gain = {"gain": (F.greatest(d, F.lit(0.0)), "sum")}
        return gain if self.exponent == 1.0 else gain | {"top": (d, "max")}

    def value(self, totals: Totals) -> Column:
        if self.exponent == 1.0:
            return _ratio(F.col("gain"), totals.n)
        a, b = self.powers
        top, n = F.greatest(F.col("top"), F.lit(0.0)), F.lit(float(max(totals.n, 1)))
        if a < b:
            size = F.least(F.greatest(_ratio(F.col("gain"), top), F.lit(1.0)), F.col("n").cast("double"))
            return F.pow(size / n, F.lit(a)) * F.pow(top, F.lit(b))
        return F.pow(F.col("n") / n, F.lit(a)) * F.pow(F.least(_ratio(F.col("gain"), F.col("n")), top), F.lit(b))


@dataclass(frozen=True)
class BinnedMeanShiftBound(MeanShift):
    """No subset's score is higher, for any exponent, to the width of a bin: rows are added up by bins of the target.

    The best subset of a size has the highest deviations. Where whole bins end its sum is
    known. Within one it is at most what the bin's upper edge gives for each row, and at
    most what is left if each row beyond it takes the lower edge from the sum at the end.
    For sums that grow so, the score is greatest at the ends or where both meet. Where they fall
    it is no more than the sum at the bin's beginning gives with the size at its end.

    ``edges`` are deviations from the mean, rising; 0 should be among them, so that no bin has both signs.
    """

    edges: tuple[float, ...] = (0.0,)

    @classmethod
    def of(cls, df: DataFrame, target: str, exponent: float = 1.0, bins: int = 16) -> BinnedMeanShiftBound:
        """Edges at about the quantiles of the target; the bound holds with any."""
        totals = Totals.of(df, target)
        found = df.select(F.percentile_approx(F.col(target).cast("double") - F.lit(totals.mean), [(i + 1) / bins for i in range(bins - 1)])).first()[0] or []
        return cls(target, exponent, tuple(sorted({0.0, *found})))

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        d = F.col(self.target).cast("double") - F.lit(totals.mean)
        out = {"top": (d, "max")}
        for i, (low, high) in enumerate(zip((float("-inf"), *self.edges), (*self.edges, float("inf")))):
            inside = (d >= F.lit(low)) & (d < F.lit(high))
            out |= {f"bin_n{i}": (F.when(inside, F.lit(1)).otherwise(F.lit(0)).cast("long"), "sum"), f"bin_d{i}": (F.when(inside, d).otherwise(F.lit(0.0)), "sum")}
        return out

    def value(self, totals: Totals) -> Column:
        a, b = self.powers
        n = F.lit(float(max(totals.n, 1)))
        # from the highest bin on: how many rows, their sum, and between which values they lie
        last = len(self.edges)
        bins = [
            F.struct(
                F.col(f"bin_n{i}").cast("double").alias("c"), F.col(f"bin_d{i}").alias("d"),
                F.lit(float(self.edges[i - 1]) if i else float("-inf")).alias("low"), (F.least(F.lit(float(self.edges[i])), F.col("top")) if i < last else F.col("top")).alias("high"),
            )
            for i in range(last, -1, -1)
        ]

        def score(size, total):
            return F.pow(size / n, F.lit(a)) * F.pow(F.when(size > 0, F.greatest(total, F.lit(0.0)) / size).otherwise(F.lit(0.0)), F.lit(b))

        def grown(had, bin_):
            size, total = had["m"] + bin_["c"], had["d"] + bin_["d"]
            wide = bin_["high"] > bin_["low"]
            met = F.greatest(F.lit(0.0), F.least(bin_["c"], F.when(wide, (bin_["d"] - bin_["c"] * bin_["low"]) / (bin_["high"] - bin_["low"])).otherwise(bin_["c"])))
            rising = F.greatest(score(size, total), score(had["m"] + met, had["d"] + met * bin_["high"]))
            best = F.when(bin_["c"] == 0, had["best"]).when(bin_["low"] >= 0, F.greatest(had["best"], rising)).otherwise(F.greatest(had["best"], score(size, had["d"])))
            return F.struct(size.alias("m"), total.alias("d"), best.alias("best"))

        start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("d"), F.lit(0.0).alias("best"))
        return F.aggregate(F.array(*bins), start, grown, lambda had: had["best"])


@dataclass(frozen=True)
class GroupedMeanShiftBound(MeanShiftBound):
    """No subset that predicates can tell apart scores higher: rows of one signature stay together, so their deviations are added up first."""

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"gain": (F.col(self.target).cast("double") - F.lit(totals.mean), "sum")} | ({} if self.exponent == 1.0 else {"top": (F.lit(float("-inf")), "max")})

    def derived(self, totals: Totals) -> dict[str, Column]:
        mean = F.col("gain") / F.col("n")
        return {"gain": F.greatest(F.col("gain"), F.lit(0.0))} | ({} if self.exponent == 1.0 else {"top": mean})


@dataclass(frozen=True)
class Mmd(Score):
    """Deviation of a group's mean map: f^(gamma - 2) * |sum of its features - m * mean of all|^2, f = m(n - m)/n or (anomaly) m.

    The target is an array whose dot products are the kernel (``kernels.features``,
    or a vector for the linear kernel); 0 for no row and for all rows.
    """

    gamma: float = 1.0
    anomaly: bool = False

    def _centred(self, totals: Totals) -> list[Column]:
        return [F.get(self.target, F.lit(i)).cast("double") - F.lit(m) for i, m in enumerate(totals.means)]

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {f"z{i}": (c, "sum") for i, c in enumerate(self._centred(totals))}

    def value(self, totals: Totals) -> Column:
        m, n = F.col("n").cast("double"), F.lit(float(totals.n))
        f = m if self.anomaly else m * (n - m) / n
        square = F.aggregate(F.array(*(F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(totals.means)))), F.lit(0.0), lambda a, v: a + v)
        return F.when(m < n, F.pow(f, F.lit(self.gamma - 2.0)) * square).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class MmdBound(Mmd):
    """No subset's score is higher, from sums and extremes alone, so that it adds up like the measure.

    A subset of size s has a squared length of at most s^2 M^2 (M the greatest
    length of a centred row), of s G (G the sum of their squares), and of B (in
    each direction the greater of the sums of one sign, squared). f is at least
    s c, c = (n - m)/n for the whole group's m, or 1 for anomalies.
    """

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        rows = self._centred(totals)
        square = F.aggregate(F.array(*(c * c for c in rows)), F.lit(0.0), lambda a, v: a + v)
        out = {"squares": (square, "sum"), "longest": (square, "max")}
        for i, c in enumerate(rows):
            out |= {f"up{i}": (F.greatest(c, F.lit(0.0)), "sum"), f"down{i}": (F.greatest(-c, F.lit(0.0)), "sum")}
        return out

    def _reach(self, totals: Totals) -> Column | None:
        return F.aggregate(F.array(*(F.pow(F.greatest(f"up{i}", f"down{i}"), F.lit(2.0)) for i in range(len(totals.means)))), F.lit(0.0), lambda a, v: a + v)

    def value(self, totals: Totals) -> Column:
        g, m, n = self.gamma, F.col("n").cast("double"), float(totals.n)
        reach, longest, squares = self._reach(totals), F.greatest(F.col("longest"), F.lit(0.0)), F.col("squares")
        # s^(g - 2) times the least of s^2 M^2, s G and B
        bounds = [F.pow(m, F.lit(g)) * longest]
        bounds.append(F.pow(longest, F.lit(1 - g)) * F.pow(squares, F.lit(g)) if g <= 1 else F.pow(m, F.lit(g - 1)) * squares)
        if reach is not None:
            bounds.append(F.pow(longest, F.lit(1 - g / 2)) * F.pow(reach, F.lit(g / 2)))
        # no proper subset of all rows is larger than n - 1
        c = F.lit(1.0) if self.anomaly else (F.lit(n) - F.least(m, F.lit(n - 1))) / F.lit(n)
        return F.pow(c, F.lit(g - 2.0)) * F.least(*bounds)


@dataclass(frozen=True)
class GroupedMmdBound(MmdBound):
    """No subset that predicates can tell apart scores higher: rows of one signature stay together.

    With W the sum of a signature's m centred rows, a union of signatures has a squared
    length of at most its size times the sum of |W|^2 / m over them, and of at most its size squared
    times the greatest |W|^2 / m^2: what ``MmdBound`` has for single rows.
    """

    def _reach(self, totals: Totals) -> Column | None:
        return None

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return Mmd.parts(self, totals) | {"squares": (F.lit(0.0), "sum"), "longest": (F.lit(float("-inf")), "max")}

    def derived(self, totals: Totals) -> dict[str, Column]:
        square = F.aggregate(F.array(*(F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(totals.means)))), F.lit(0.0), lambda a, v: a + v)
        return {"squares": square / F.col("n"), "longest": square / (F.col("n") * F.col("n"))}


@dataclass(frozen=True)
class MmdHistogramBound(MmdBound):
    """No subset's score is higher, and none than ``MmdBound`` says, from histograms along the leading axes of all rows.

    Along an axis of unit length the squared sum of a subset's centred rows is at most
    the axis's eigenvalue times its share of the subset's centred 0/1 vector; the
    shares add up to that vector's squared length at most. An axis's own share is bounded by the greatest sum of so
    many entries, from a histogram: whole bins by their sums, a part of one by its edges.
    The length is given to the axes of largest eigenvalue first, what is left to the next
    axis. Sizes are tried one by one as long as they are few, then in intervals, each with the
    greatest sums, the greatest and the least length in it.

    ``axes`` are rows of unit vectors, ``values`` their eigenvalues and the next one, ``edges`` each axis's bins, 0 among them.
    """

    axes: tuple[tuple[float, ...], ...] = ()
    values: tuple[float, ...] = (float("inf"),)
    edges: tuple[tuple[float, ...], ...] = ()

    @classmethod
    def of(cls, df: DataFrame, target: str, gamma: float = 1.0, anomaly: bool = False, rank: int = 8, bins: int = 8) -> MmdHistogramBound:
        """Axes of the target's moments, a matrix of the vectors' length; bins at about the quantiles along each."""
        df = measured(df, target)
        totals = Totals.of(df, target)
        mean = np.array(totals.means, float)
        if not totals.n or not len(mean):
            return cls(target, gamma, anomaly)
        values, vectors = np.linalg.eigh(moments(df, target, len(mean)) - totals.n * np.outer(mean, mean))
        order = [i for i in np.argsort(values)[::-1] if values[i] > 1e-9 * max(values.max(), 1e-300)]
        axes = tuple(tuple(map(float, vectors[:, i])) for i in order[:rank])
        rest = float(values[order[rank]]) if len(order) > rank else 0.0
        made = cls(target, gamma, anomaly, axes, (*(float(values[i]) for i in order[:rank]), rest), ())
        if not axes:
            return made
        along = df.select(*(c.alias(f"a{i}") for i, c in enumerate(made._along(totals))))
        wanted = [(i + 1) / bins for i in range(bins - 1)]
        found = along.agg(*(x for i in range(len(axes)) for x in (F.min(f"a{i}"), F.max(f"a{i}"), F.percentile_approx(f"a{i}", wanted)))).first()
        edges = []
        for i in range(len(axes)):
            low, high, cuts = found[3 * i : 3 * i + 3]
            wide = 1e-9 * max(1.0, abs(low), abs(high))
            edges.append(tuple(sorted({min(low, 0.0) - wide, *cuts, 0.0, max(high, 0.0) + wide})))
        return replace(made, edges=tuple(edges))

    def _along(self, totals: Totals) -> list[Column]:
        rows = F.array(*self._centred(totals))
        return [F.aggregate(F.zip_with(rows, F.array(*map(F.lit, axis)), lambda x, v: x * v), F.lit(0.0), lambda a, v: a + v) for axis in self.axes]

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        if not self.axes:
            return super().parts(totals)
        most = max(map(len, self.edges)) - 1
        bins = F.array(*(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in [*zip(e, e[1:]), *[(float("inf"), float("inf"))] * (most + 1 - len(e))])) for e in self.edges))
        one, none = F.lit(1.0), F.lit(0.0)
        each = F.zip_with(F.array(*self._along(totals)), bins, lambda w, own: F.concat(F.transform(own, lambda b: F.when((w >= b["low"]) & (w < b["high"]), one).otherwise(none)), F.transform(own, lambda b: F.when((w >= b["low"]) & (w < b["high"]), w).otherwise(none))))
        return super().parts(totals) | {"along": (F.flatten(each), f"vector:{2 * most * len(self.axes)}")}

    def value(self, totals: Totals) -> Column:
        loose = super().value(totals)
        if not self.axes:
            return loose
        known, most = (self.values, self.edges, totals.n), max(map(len, self.edges)) - 1
        gamma, anomaly = self.gamma, self.anomaly

        def sharp(along: pd.Series, sizes: pd.Series) -> pd.Series:
            return pd.Series([_histogram_bound(np.asarray(h, float).reshape(-1, 2, most), *known, int(m), gamma, anomaly) for h, m in zip(along, sizes)], dtype=float)

        return F.least(loose, F.pandas_udf(sharp, "double")(F.col("along"), F.col("n")))


def _greatest_sums(count, total, low, high, starts, stops):
    """For sizes from ``starts`` to ``stops`` what no sum of so many entries exceeds; bins from the highest on, none of both signs."""
    peak = count[low >= 0].sum()
    at = np.clip(peak, starts, stops)
    ends = np.cumsum(count)
    j = np.minimum(np.searchsorted(ends, at, side="left"), len(count) - 1)
    part = at - (ends[j] - count[j])
    return (np.cumsum(total) - total)[j] + np.minimum(part * high[j], total[j] - (count[j] - part) * low[j])


def _histogram_bound(hist: np.ndarray, values, edges, n: int, m: int, gamma: float, anomaly: bool) -> float:
    m = min(m, n - 1)  # for all rows the score is 0
    if m < 1:
        return 0.0
    stops = np.arange(1, min(m, 64) + 1)
    if m > 64:
        stops = np.unique(np.append(stops, np.minimum(np.ceil(64 * 1.04 ** np.arange(1, 2 + np.log(m / 64) / np.log(1.04))), m).astype(np.int64)))
    starts = np.append(1, stops[:-1] + 1)
    lengths = np.stack([starts * (n - starts) / n, stops * (n - stops) / n])
    longest = np.where((starts <= n / 2) & (stops >= n / 2), n / 4, lengths.max(axis=0))
    shares = []
    for (count, total), e, value in zip(hist, edges, values):
        low, high, k = np.array(e[:-1]), np.array(e[1:]), len(e) - 1
        up = _greatest_sums(count[:k][::-1], total[:k][::-1], low[::-1], high[::-1], starts, stops)
        down = _greatest_sums(count[:k], -total[:k], -high, -low, starts, stops)
        shares.append(np.maximum(np.maximum(up, down), 0) ** 2 / value)
    share = np.array(shares)
    given = np.clip(longest - (np.cumsum(share, axis=0) - share), 0, share)
    reach = np.array(values[:-1]) @ given + values[-1] * np.maximum(longest - share.sum(axis=0), 0)
    f = np.stack([starts, stops]).astype(float) if anomaly else np.stack([lengths.min(axis=0), longest])
    return float((np.power(f, gamma - 2).max(axis=0) * reach).max()) * (1 + 1e-9)


@dataclass(frozen=True)
class EdgeVertexRatio(Score):
    """The edges that a group of vertices induces, over its vertices."""

    def value(self, totals: Totals) -> Column:
        return _ratio(F.col("edges").cast("double"), F.col("n"))


@dataclass(frozen=True)
class EdgeVertexBound(Score):
    """No subset has more edges a vertex.

    A subset of size s has at most all edges of the group, s (s - 1) / 2, s times half
    the greatest degree, and s times the greatest coreness (drop vertices one by one, each with that many neighbours at most).
    """

    columns: ClassVar[tuple[str, ...]] = ("degree", "core")

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"top_degree": (F.col("degree"), "max"), "top_core": (F.col("core"), "max")}

    def value(self, totals: Totals) -> Column:
        # both E / s and (s - 1) / 2 are met where s (s - 1) = 2 E
        met = (F.sqrt(8 * F.col("edges") + 1) - 1) / 4
        return F.least(met, F.col("top_degree") / 2, F.col("top_core").cast("double"))


@dataclass(frozen=True)
class LocalModularity(Score):
    """The share of all edges within the group, less what its degrees alone let expect."""

    columns: ClassVar[tuple[str, ...]] = ("degree",)

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"volume": (F.col("degree"), "sum")}

    def value(self, totals: Totals) -> Column:
        share = _ratio(F.col("volume").cast("double"), 2.0 * totals.edges)
        return _ratio(F.col("edges").cast("double"), totals.edges) - share * share


@dataclass(frozen=True)
class LocalModularityBound(Score):
    """No subset's score is higher: with a share of x of the edges its degrees make at least x of all, so x - x^2 at most, and x is at most the group's."""

    def value(self, totals: Totals) -> Column:
        x = F.least(_ratio(F.col("edges").cast("double"), totals.edges), F.lit(0.5))
        return x - x * x


@dataclass(frozen=True)
class InverseConductance(LocalModularity):
    """1 less the share of the smaller side's edge ends that cross the group's border; 0 if a side has none."""

    def value(self, totals: Totals) -> Column:
        volume = F.col("volume").cast("double")
        side = F.least(volume, F.lit(2.0 * totals.edges) - volume)
        return F.when(side > 0, 1 - (volume - 2 * F.col("edges")) / side).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class InverseConductanceBound(Score):
    """A subset with no edge has all its ends across the border; any other may have none."""

    def value(self, totals: Totals) -> Column:
        return F.when(F.col("edges") > 0, F.lit(1.0)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class AverageCoreness(Score):
    """Coverage and mean coreness in the graph that the group induces: (m/n)^gamma times the mean."""

    gamma: float = 1.0
    columns: ClassVar[tuple[str, ...]] = ("core",)
    shells: ClassVar[bool] = True

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {"top_core": (F.col("core"), "max")}

    def _covers(self, totals: Totals, n: Column) -> Column:
        return F.pow(_ratio(n.cast("double"), totals.n), F.lit(float(self.gamma)))

    def value(self, totals: Totals) -> Column:
        cores = F.aggregate("shells", F.lit(0).cast("long"), lambda a, s: a + s["core"] * s["n"])
        return self._covers(totals, F.col("n")) * _ratio(cores.cast("double"), F.col("n"))

    def outer(self, totals: Totals) -> Column:
        return self._covers(totals, F.col("n")) * F.col("top_core")


@dataclass(frozen=True)
class InducedMaxCoreness(AverageCoreness):
    """No subset's average coreness is higher: its vertices have at most the group's greatest coreness."""

    def value(self, totals: Totals) -> Column:
        return self._covers(totals, F.col("n")) * F.coalesce(F.get("shells", F.lit(0))["core"], F.lit(0))


@dataclass(frozen=True)
class InducedAverageCoreness(AverageCoreness):
    """No subset's average coreness is higher: in a subset no vertex gains, so the best of any size are those of highest coreness.

    Within a shell the score falls and then rises with the size, so only whole shells are tried.
    """

    def value(self, totals: Totals) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cores"), F.lit(0.0).alias("best"))

        def grown(a, s):
            n, cores = a["n"] + s["n"], a["cores"] + s["core"] * s["n"]
            return F.struct(n.alias("n"), cores.alias("cores"), F.greatest(a["best"], self._covers(totals, n) * cores / n).alias("best"))

        return F.aggregate("shells", start, grown, lambda a: a["best"])


@dataclass(frozen=True)
class Geometric(Score):
    """Weighted geometric mean of scores (or of bounds, which bounds it): product of powers, to 1 over their sum."""

    scores: tuple[Score, ...] = ()
    exponents: tuple[float, ...] = field(default=())

    @property
    def columns(self) -> tuple[str, ...]:  # type: ignore[override]
        return tuple(c for s in self.scores for c in s.columns)

    @property
    def shells(self) -> bool:  # type: ignore[override]
        return any(s.shells for s in self.scores)

    def parts(self, totals: Totals) -> dict[str, tuple[Column, str]]:
        return {k: v for s in self.scores for k, v in s.parts(totals).items()}

    def derived(self, totals: Totals) -> dict[str, Column]:
        return {k: v for s in self.scores for k, v in s.derived(totals).items()}

    def value(self, totals: Totals) -> Column:
        e = self.exponents or (1.0,) * len(self.scores)
        out = F.lit(1.0)
        for s, x in zip(self.scores, e):
            out = out * F.pow(s.value(totals), F.lit(float(x)))
        return F.pow(out, F.lit(1.0 / sum(e)))


MEASURES = {"coverage": Coverage, "jaccard": Jaccard, "coverage-mean-shift": MeanShift, "mmd": Mmd, "geometric-mean": Geometric} | {
    "edge-vertex-ratio": EdgeVertexRatio, "local-modularity": LocalModularity, "inverse-conductance": InverseConductance, "coverage-average-coreness": AverageCoreness,
}
BOUNDS = {"coverage": Coverage, "constant": Constant, "jaccard": JaccardBound, "coverage-mean-shift": MeanShiftBound, "coverage-mean-shift-grouped": GroupedMeanShiftBound, "coverage-mean-shift-binned": BinnedMeanShiftBound, "mmd-sd": MmdBound, "mmd-sd-histogram": MmdHistogramBound, "mmd-sd-grouped": GroupedMmdBound, "geometric-mean": Geometric} | {
    "edge-vertex-ratio-greedy": EdgeVertexBound, "local-modularity": LocalModularityBound, "inverse-conductance": InverseConductanceBound,
    "coverage-induced-max-coreness": InducedMaxCoreness, "coverage-induced-average-coreness": InducedAverageCoreness,
}


def from_text(text: str, target: str | None = None, known: dict[str, type[Score]] = MEASURES) -> Score:
    """A score from ``name``, ``name(value, key=value)``, or several of these: their geometric mean.

    Exponents of a mean may follow in brackets: ``coverage jaccard [1, 2]``.
    """
    body, _, tail = text.partition("[")
    found = re.findall(r"([a-z-]+)\s*(?:\(([^)]*)\))?", body)
    if not found or any(name not in known for name, _ in found):
        raise ValueError(f"no such score: {text!r}")
    made = []
    for name, given in found:
        kind = known[name]
        own = [f.name for f in fields(kind) if f.name != "target"]
        args = [a.partition("=") if "=" in a else (own[i], "=", a) for i, a in enumerate(filter(str.strip, (given or "").split(",")))]
        made.append(kind(target=target, **{k.strip(): literal_eval(v.strip()) for k, _, v in args}))
    if len(made) == 1 and not tail:
        return made[0]
    return Geometric(target, tuple(made), tuple(map(float, literal_eval("[" + tail))) if tail else ())


def sorted_bound(members: DataFrame, key: str, target: str, totals: Totals, exponent: float = 1.0) -> DataFrame:
    """(key, bound): the exact maximum over each group's subsets, from prefixes of its rows by falling target.

    Running sums go by ranges of distinct values, so no group is one task. Of rows with one
    value the best number is all of them or, where their value is below the mean and coverage weighs
    more, one of the whole numbers around the place where the score turns.
    """
    a, b = MeanShift(target, exponent).powers
    values = members.where(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(key, (-F.col(target).cast("double")).alias("_down")).agg(F.count(F.lit(1)).alias("c"))
    run = running(values, [key], ["_down"], {"m": F.col("c"), "s": -F.col("_down") * F.col("c")})
    y = -F.col("_down")
    shift, before = y - F.lit(totals.mean), (F.col("m") - F.col("c")).cast("double")
    start = F.col("s") - y * F.col("c") - before * F.lit(totals.mean) - shift * before
    turn = F.when((shift < 0) & F.lit(a > b), F.lit(-(a - b) / a) * start / shift).otherwise(F.col("m"))

    def score(size):
        size = F.greatest(before + 1, F.least(size, F.col("m").cast("double")))
        return F.pow(size / F.lit(float(totals.n)), F.lit(a)) * F.pow(F.greatest((start + shift * size) / size, F.lit(0.0)), F.lit(b))

    best = F.greatest(score(F.col("m").cast("double")), score(F.floor(turn).cast("double")), score(F.ceil(turn).cast("double")))
    return run.groupBy(key).agg(F.max(best).alias("bound"))


def grouped_bound(groups: DataFrame, key: str, totals: Totals) -> DataFrame:
    """(key, bound) for exponent 1 when rows that no predicate separates move together: groups of (key, signature, shift)."""
    return groups.groupBy(key).agg((F.sum(F.greatest(F.col("shift"), F.lit(0.0))) / F.lit(float(totals.n))).alias("bound"))
