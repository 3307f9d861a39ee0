"""Bounds by running sums over ranges and by bins, against all subsets and against each other."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospect.functions.predicates import Truth, attributes
from prospect.operators import kernels, language, prefix, scores, search


def test_running_sums_of_a_group_with_most_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", int(v), i) for i, v in enumerate(rng.integers(0, 50, 600))]
    df = spark.createDataFrame(rows, "g string, v int, row int")
    found = prefix.running(df, ["g"], ["v", "row"], {"n": F.lit(1), "sum": F.col("v")})
    # the hot group stands in several ranges
    assert df.repartitionByRange(4, "g", "v", "row").where("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    got = sorted((r["g"], r["v"], r["row"], r["n"], r["sum"]) for r in found.collect())
    want = []
    for g in {r[0] for r in rows}:
        total = 0
        for n, (_, v, row) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            total += v
            want.append((g, v, row, n, total))
    assert got == sorted(want)
    assert prefix.running(df.limit(0), ["g"], ["v"], {"n": F.lit(1)}).collect() == []


def best_subset(y, inside, e):
    a, b = e / max(e, 1), 1 / max(e, 1)
    d = np.sort(y[inside] - y.mean())[::-1]
    m = np.arange(1, len(d) + 1)
    return float(((m / len(y)) ** a * np.maximum(np.cumsum(d) / m, 0) ** b).max())


@pytest.mark.parametrize("exponent", [0.25, 0.5, 1.0, 2.0, 5.0])
def test_binned_bound_lies_between_the_best_subset_and_the_closed_form(spark, exponent):
    rng = np.random.default_rng(7)
    y = np.round(rng.standard_t(3, size=300), 1)
    groups = {g: rng.random(300) < p for g, p in enumerate((0.02, 0.1, 0.3, 0.7, 1.0))} | {9: y < y.mean() - 1}
    df = spark.createDataFrame([(g, float(v)) for g, m in groups.items() for v in y[m]], "g int, y double")
    whole = spark.createDataFrame([(float(v),) for v in y], "y double")
    totals = scores.Totals.of(whole, "y")
    closeness = {}
    for bins in (4, 64):
        bound = scores.BinnedMeanShiftBound.of(whole, "y", exponent, bins)
        parts = bound.parts(totals)
        added = df.select("g", *(c.alias(k) for k, (c, _) in parts.items())).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(getattr(F, how)(k).alias(k) for k, (_, how) in parts.items()))
        got = {r["g"]: r["v"] for r in added.select("g", bound.value(totals).alias("v")).collect()}
        best = {g: best_subset(y, m, exponent) for g, m in groups.items() if m.any()}
        assert got.keys() == best.keys() and {g: (got[g], best[g]) for g in best if not got[g] >= best[g] - 1e-9} == {} and all(got[g] >= best[g] - 1e-9 for g in best)
        closeness[bins] = max(got[g] - best[g] for g in best)
    assert closeness[64] <= closeness[4] + 1e-9 and closeness[64] < 0.12 * max(best.values())
    exact = {r["g"]: r["bound"] for r in scores.sorted_bound(df, "g", "y", totals, exponent).collect()}
    assert {g: (exact[g], best[g]) for g in best if abs(exact[g] - best[g]) >= 1e-9} == {}


def test_mean_deviation_bound_of_one_large_group(spark):
    """One group holds most rows; the bound is the one that the whole matrix gives, and no subset exceeds it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(26, 3))
    group = np.array(["hot"] * 18 + ["a"] * 6 + ["b"] * 2)
    df = spark.createDataFrame([(i, x[i].tolist(), str(group[i])) for i in range(26)], "id int, x array<double>, g string")
    values, vectors = np.linalg.eigh(x @ x.T)
    values, vectors = values[::-1][:3], vectors[:, ::-1][:, :3]
    got = {r["g"]: r["bound"] for r in kernels.mean_deviation_bound(df, "x", "g").collect()}
    want = {g: kernels.mmd_bound(values, vectors, (group == g).astype(int)) for g in ("hot", "a", "b")}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-6 for g in want)
    mu = x.mean(axis=0)
    for g in ("a", "b"):
        own = np.flatnonzero(group == g)
        for k in range(1, len(own) + 1):
            for s in itertools.combinations(own, k):
                z = (x[list(s)] - mu).sum(axis=0)
                assert z @ z / (k * (26 - k) / 26) <= got[g] + 1e-9


@pytest.mark.parametrize("anomaly", [False, True])
@pytest.mark.parametrize("gamma", [0.5, 1.0, 1.5])
def test_histogram_bound_lies_between_every_subset_and_the_loose_bound(spark, anomaly, gamma):
    rng = np.random.default_rng(11)
    n, dims = 40, 5
    x = rng.normal(size=(n, dims)) * [3, 2, 1, 0.5, 0.2] + 1.5
    groups = {0: np.arange(9), 1: np.arange(20, 31), 2: np.arange(38, 40), 3: np.arange(n)}
    whole = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    df = spark.createDataFrame([(g, x[i].tolist()) for g, own in groups.items() for i in own], "g int, x array<double>")
    totals = scores.Totals.of(whole, "x")
    mu = x.mean(axis=0)

    def score(s):
        m, z = len(s), (x[s] - mu).sum(axis=0)
        return 0.0 if m == n else (m if anomaly else m * (n - m) / n) ** (gamma - 2) * float(z @ z)

    best = {g: max(score(list(s)) for k in range(1, len(own) + 1) for s in itertools.combinations(own, k)) for g, own in groups.items() if g < 3}
    best[3] = max([max(best.values()), *(score(rng.choice(n, k, replace=False)) for k in rng.integers(1, n, 500))])
    near = {}
    for rank, bins in ((5, 32), (2, 4), (0, 4)):
        bound = scores.MmdHistogramBound.of(whole, "x", gamma, anomaly, rank, bins)
        got = {}
        for kind in (bound, scores.MmdBound("x", gamma, anomaly)):
            parts = kind.parts(totals)
            rows = df.select("g", *(c.alias(k) for k, (c, _) in parts.items())).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(language.added(k, how).alias(k) for k, (_, how) in parts.items()))
            got[type(kind)] = {r["g"]: r["v"] for r in rows.select("g", kind.value(totals).alias("v")).collect()}
        sharp, loose = got[scores.MmdHistogramBound], got[scores.MmdBound]
        assert {g: (sharp[g], best[g], loose[g]) for g in best if not best[g] - 1e-9 <= sharp[g] <= loose[g] + 1e-9} == {}
        near[rank] = sum(sharp[g] / best[g] for g in best)
    assert near[5] <= near[2] + 1e-6 and near[5] < near[0]


def test_histogram_bounds_of_large_groups_go_by_intervals():
    """Sizes in intervals bound what they bound one by one."""
    rng = np.random.default_rng(2)
    n = 3000
    x = rng.normal(size=(n, 2)) * [2, 1]
    x -= x.mean(axis=0)
    values, vectors = np.linalg.eigh(x.T @ x)
    w = x @ vectors[:, ::-1]
    edges = [tuple(sorted({w[:, d].min() - 1, *np.quantile(w[:, d], np.linspace(0.1, 0.9, 9)), 0.0, w[:, d].max() + 1})) for d in range(2)]
    most = max(map(len, edges)) - 1
    own = rng.choice(n, 1200, replace=False)
    hist = np.zeros((2, 2, most))
    for d in range(2):
        k = np.digitize(w[own, d], edges[d]) - 1
        np.add.at(hist[d, 0], k, 1)
        np.add.at(hist[d, 1], k, w[own, d])
    bound = scores._histogram_bound(hist, (*values[::-1], 0.0), edges, n, len(own), 1.0, False)
    order = [np.argsort(w[own] @ v) for v in ([1, 0], [0, 1], [1, 1], [1, -1])]
    top = max(float(z @ z) / (k * (n - k) / n) for o in order for oo in (o, o[::-1]) for k in range(1, 1201, 7) for z in [w[own][oo[:k]].sum(axis=0)])
    assert top <= bound <= values[-1] * (1 + 1e-6) * 1.1


@pytest.mark.parametrize("anomaly", [False, True])
@pytest.mark.parametrize("gamma", [0.5, 1.0, 1.5])
def test_grouped_mean_deviation_bound_covers_unions_of_signatures(spark, anomaly, gamma):
    rng = np.random.default_rng(5)
    n = 60
    x, flags = rng.normal(size=(n, 3)) + 2, rng.random((n, 3)) < 0.5
    df = spark.createDataFrame([(x[i].tolist(), *map(bool, flags[i])) for i in range(n)], "x array<double>, f0 boolean, f1 boolean, f2 boolean")
    predicates = [Truth(a) for a in attributes(df, exclude=("x",))]
    mu = x.mean(axis=0)
    kinds = sorted({tuple(f) for f in flags.tolist()})
    own = {k: np.flatnonzero((flags == k).all(axis=1)) for k in kinds}

    def score(s):
        m, z = len(s), (x[s] - mu).sum(axis=0)
        return 0.0 if m == n else (m if anomaly else m * (n - m) / n) ** (gamma - 2) * float(z @ z)

    def best(c):
        inside = [k for k in kinds if all(k[i] for i in c)]
        return max(score(np.concatenate([own[k] for k in s])) for r in range(1, len(inside) + 1) for s in itertools.combinations(inside, r))

    seen = {}
    bound = scores.GroupedMmdBound("x", gamma, anomaly)
    found = search.search(df, predicates, scores.Mmd("x", gamma, anomaly), bound, 50, 3, visit=lambda level, fs: seen.update({f.indices: f.bound for f in fs}))
    assert all(seen[c] >= best(c) - 1e-9 for c in seen) and len(seen) == 8
    top = search.search(df, predicates, scores.Mmd("x", gamma, anomaly), bound, 3, 3)
    assert [(f.indices, round(f.score, 9)) for f in top.best] == [(f.indices, round(f.score, 9)) for f in found.best[:3]]
