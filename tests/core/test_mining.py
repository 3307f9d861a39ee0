"""Predicates, scores, bounds and search against enumeration; kernels and graphs against plain numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospect.functions.discretise import Fixed, Frequency, Ranges, Uniform, entropy, level_names
from prospect.functions.predicates import Attribute, Equals, Kind, Negate, Prediciser, Ranged, Truth, attributes, kind_of
from prospect.operators import alignment, graphs, ingest, kernels, language, learning, scores, search, summary
from prospect.plans.computation import Computation
from prospect.sources import readers, texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a", 1.0, True), (2, "b", float("nan"), None), (3, None, None, False), (4, "a", float("inf"), True), (5, "c", -2.0, False)]
    return spark.createDataFrame(rows, "id long, cat string, num double, flag boolean")


def test_kinds(odd):
    found = attributes(odd, {"id": "index"})
    assert [(a.name, a.kind, a.selected) for a in found] == [("id", Kind.INDEX, False), ("cat", Kind.CATEGORICAL, True), ("num", Kind.NUMERICAL, True), ("flag", Kind.BOOLEAN, True)]
    from pyspark.sql import types as T

    with pytest.raises(TypeError):
        kind_of(T.DateType())


def test_missing_values_hold_nowhere_and_their_negation_everywhere(odd):
    p = [Equals(Attribute("cat", Kind.CATEGORICAL), category="a"), Ranged(Attribute("num", Kind.NUMERICAL), interval=Fixed(ranges=Ranges.SLABS_POSITIVE).intervals([0.0, 1.0])[0]), Truth(Attribute("flag", Kind.BOOLEAN))]
    rows = odd.orderBy("id").select(*(x.column() for q in p for x in (q, q.negate()))).collect()
    for r in rows:
        assert None not in r and all(r[i] != r[i + 1] for i in (0, 2, 4))
    assert [r[2] for r in rows] == [True, False, False, True, False]


def test_cuts_and_intervals(spark, odd):
    values = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    assert Frequency(3).cuts(values, ["x"])["x"] == [25.0, 50.0, 75.0]
    assert Frequency(3, midpoints=True).cuts(values, ["x"])["x"] == [24.5, 49.5, 74.5]
    assert Uniform(3).cuts(values, ["x"])["x"] == [25.75, 50.5, 75.25]
    assert Uniform(3).cuts(odd, ["num"])["num"] == [-1.25, -0.5, 0.25]
    made = Fixed(3, Ranges.parse("INTERVALS|SLABS_NEGATIVE")).intervals([1.0, 2.0])
    assert [(i.lower, i.upper) for i in made] == [(None, 1.0), (1.0, 2.0), (2.0, None), (None, 1.0), (None, 2.0)]
    assert len(Fixed().intervals([3.0])) == 2 and Fixed().intervals([]) == []
    assert level_names(3) == ["low", "med", "high"] and abs(entropy([1, 1]) - math.log(2)) < 1e-12


def test_two_categories_are_not_negated(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("x", "r")], "two string, three string")
    found = [str(p) for p in Prediciser().predicates(df, attributes(df))]
    assert found == ["[two=x]", "[two=y]", "[three=p]", "[three!=p]", "[three=q]", "[three!=q]", "[three=r]", "[three!=r]"]


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.5, rng.random() < 0.3, rng.choice("xyz"), rng.random(), rng.gauss(0, 1)) for _ in range(120)]
    rows = [(a, b, c, d, y + (2 if a and c == "x" else 0)) for a, b, c, d, y in rows]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c string, d double, y double").persist()
    return df, Prediciser(Frequency(2)).predicates(df, attributes(df, exclude=["y"]))


def _table(df, predicates):
    rows = df.select(*(p.column().alias(str(i)) for i, p in enumerate(predicates)), "y").collect()
    return np.array([r[:-1] for r in rows], bool), np.array([r[-1] for r in rows])


@pytest.mark.parametrize("exponent", [1.0, 0.5, 2.0])
def test_search_equals_enumeration(toy, exponent):
    df, predicates = toy
    held, y = _table(df, predicates)
    a, b = scores.MeanShift("y", exponent).powers

    def value(m):
        return (m.sum() / len(y)) ** a * max(y[m].mean() - y.mean(), 0) ** b

    every = []
    for d in range(4):
        for c in itertools.combinations(range(len(predicates)), d):
            m = held[:, list(c)].all(axis=1)
            if m.any():
                every.append((-round(value(m), 6), d, c))
    want = sorted(every)[:6]
    found = search.search(df, predicates, scores.MeanShift("y", exponent), scores.MeanShiftBound("y", exponent), 6, 3)
    assert [(-round(f.score, 6), len(f.indices), f.indices) for f in found.best] == want


def test_closed_search_visits_each_closed_set_once(toy):
    df, predicates = toy
    held, _ = _table(df, predicates)
    closed = set()
    for d in range(len(predicates) + 1):
        for c in itertools.combinations(range(len(predicates)), d):
            m = held[:, list(c)].all(axis=1)
            if m.any():
                closed.add(tuple(np.flatnonzero(held[m].all(axis=0)).tolist()))
    seen = []
    found = search.search(df, predicates, scores.Coverage(), None, 10_000, len(predicates), closed=True, visit=lambda level, fs: seen.extend(f.indices for f in fs))
    assert sorted(seen) == sorted(closed) and {f.indices for f in found.best} == closed


def test_mean_shift_bounds_cover_every_subset(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=60)
    inside = np.arange(60) < 10
    best = {e: max(((len(s) / 60) ** (e / max(e, 1))) * max(y[list(s)].mean() - y.mean(), 0) ** (1 / max(e, 1)) for k in range(1, 11) for s in itertools.combinations(range(10), k)) for e in (0.5, 1.0, 2.0)}
    df = spark.createDataFrame([(int(m), float(v)) for m, v in zip(inside, y)], "g int, y double")
    totals = scores.Totals.of(df, "y")
    for e, top in best.items():
        exact = scores.sorted_bound(df.where("g = 1"), "g", "y", totals, e).first()["bound"]
        assert abs(exact - top) < 1e-9
        bound = scores.MeanShiftBound("y", e)
        parts = bound.parts(totals)
        from pyspark.sql import functions as F

        loose = df.where("g = 1").select(*(c.alias(k) for k, (c, _) in parts.items())).agg(F.count(F.lit(1)).alias("n"), *(getattr(F, how)(k).alias(k) for k, (_, how) in parts.items())).select(bound.value(totals)).first()[0]
        assert loose >= top - 1e-9 and (e != 1.0 or abs(loose - top) < 1e-9)


@pytest.mark.parametrize("rank", [2, 3, 5])
@pytest.mark.parametrize("anomaly", [False, True])
def test_mean_deviation_and_its_bound(rank, anomaly):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(40, rank))
    k = x @ x.T
    values, vectors = kernels.spectrum(k, rank)
    inside = np.arange(40) < 9
    top = 0.0
    for bits in range(1, 1 << 9):
        m = np.zeros(40, bool)
        m[:9] = [bits >> i & 1 for i in range(9)]
        n, size = 40, m.sum()
        z = m - size / n
        f = size if anomaly else size * (n - size) / n
        direct = z @ k @ z / f
        assert abs(direct - kernels.mmd(values, vectors, m, anomaly=anomaly)) < 1e-8
        top = max(top, direct)
    assert kernels.mmd_bound(values, vectors, inside, anomaly=anomaly) >= top - 1e-9


def test_gram_and_group_sums(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(30)], "id long, x array<double>, g int")
    for kernel in (kernels.linear(), kernels.rbf(1.5), kernels.rbf(1.0, "exp")):
        want = kernels.matrix(x, x, kernel)
        got = {(r["i"], r["j"]): r["k"] for r in kernels.gram(df, "id", "x", kernel).collect()}
        assert len(got) == 30 * 31 // 2 and all(abs(want[i, j] - v) < 1e-9 for (i, j), v in got.items())
        sums = {(r["ga"], r["gb"]): r["s"] for r in kernels.group_sums(df, "id", "x", "g", kernel).collect()}
        assert all(abs(sums[str(a), str(b)] - want[a::3, b::3].sum()) < 1e-9 for a in range(3) for b in range(3))


def test_alignment_coefficients():
    rng = np.random.default_rng(5)
    target = (x := rng.normal(size=(20, 2))) @ x.T
    others = [target + 0.1 * np.eye(20), (z := rng.normal(size=(20, 2))) @ z.T]
    a = alignment.coefficients(*alignment.frobenius(others, target))
    assert a[0] > 0.9 and abs(np.linalg.norm(a) - 1) < 1e-12
    assert alignment.best_sigma(x, np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 8), [0.5, 1.0, 2.0, 4.0])[0] == 2.0


def test_graphs(spark):
    clique = [(a, b) for a in range(4) for b in range(a)]
    edges = spark.createDataFrame([*clique, (3, 4), (4, 5)], "src long, dst long")
    assert {r["vid"]: r["core"] for r in graphs.coreness(edges).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    features = spark.createDataFrame([*((v, "x") for v in range(4)), *((v, "y") for v in range(6)), (4, "z"), (5, "z")], "vid long, feature string")
    density = {r["feature"]: r["density"] for r in graphs.feature_density(edges, features).collect()}
    assert density == {"x": 1.5, "y": 8 / 6, "z": 0.5}
    found = graphs.communities(edges, features, 2)
    assert found[0]["features"] == ["x"] and found[0]["n_edges"] == 6
    labels = spark.createDataFrame([(v, "l") for v in range(6)], "vid long, label string")
    wl = {(r["vid"], r["round"]): r["label"] for r in graphs.wl_labels(edges, labels, 2).collect()}
    assert wl[0, 2] == wl[1, 2] == wl[2, 2] != wl[3, 2] and wl[4, 1] != wl[5, 1]
    assert graphs.is_directed(edges) and not graphs.is_directed(graphs.symmetric(edges))


def test_computation_and_report(toy, tmp_path):
    df, _ = toy
    done = Computation().load_dataset(df, "y").load_prediciser(2).load_language().load_measure("coverage-mean-shift").load_optimistic_estimator("coverage-mean-shift").optimise(3, 2)
    assert "subgroups" in done.summarise_to_json() and done.subgroups().count() == 3
    best = done.result.best[0].text
    again = done.remove_subgroup(best).optimise(1, 2)
    assert again.result.best[0].text != best
    summary.write_csv(done.subgroups(), f"file://{tmp_path}/out", digits=3)
    assert summary.renamed(done.subgroups(), {"^score$": "value"}).columns[-1] == "value"


def test_minimal_description_has_the_same_rows(toy):
    df, predicates = toy
    table = language.compress(df, predicates, {}).persist()
    (n, closed), = language.closures(table, [(0, 2)], len(predicates))
    small = language.minimal_description(table, closed, len(predicates))
    assert language.closures(table, [small], len(predicates))[0][0] == n and set(small) <= set(closed)
    end = language.needed_end(table, closed, len(predicates))
    assert language.closures(table, [tuple(closed[:end])], len(predicates))[0][0] == n


def test_readers(spark, tmp_path):
    (tmp_path / "k.dat").write_text("@relation r\n@attribute a integer [0, 9]\n@attribute b real [0, 1]\n@attribute c {u, v}\n@inputs a, b\n@outputs c\n@data\n1, 0.5, u\n2, ?, v\n")
    assert [tuple(r) for r in readers.load(spark, f"keel:{tmp_path}/k.dat").collect()] == [(1, 0.5, "u"), (2, None, "v")]
    (tmp_path / "p.csv").write_text("x y label\n1 2 a\n3 4 b\n")
    assert readers.load(spark, f"points:{tmp_path}/p.csv,kind=boolean").columns == ["a", "b", "position"]
    for suffix, text in (("A", "1, 2\n2, 1\n3, 4\n"), ("graph_indicator", "1\n1\n2\n2\n"), ("graph_labels", "7\n8\n"), ("node_labels", "0\n1\n0\n1\n")):
        (tmp_path / f"g_{suffix}.txt").write_text(text)
    v, e, t = readers.graphs(spark, str(tmp_path), "g", both_ways=True)
    assert sorted(map(tuple, e.collect())) == [(1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 1, 0)] and v.count() == 4 and sorted(map(tuple, t.collect())) == [(1, 7), (2, 8)]
    ids, k = readers.unpack_kernel(b"\x00\x00\x00\x02" + np.array([5, 6], "<u8").tobytes() + bytes([9, 3, 7]))
    assert ids.tolist() == [5, 6] and k.tolist() == [[9, 3], [3, 7]]
    assert readers.columns_of("1, ?, 3\n2-3:x, 5:y") == [(0, 0, "1"), (0, 2, "3"), (1, 1, "x"), (1, 2, "x"), (1, 4, "y")]


def test_ingest(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    path = f"file://{tmp_path}/store"
    ingest.store(a, path, "id")
    ingest.store(spark.createDataFrame([(2, "other"), (3, "z")], "id long, v string"), path, "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "y"), (3, "z")]
    smooth = ingest.low_pass(np.sin(np.arange(200) / 20) + np.tile([0.5, -0.5], 100), 0.1)
    assert np.abs(smooth[20:-20] - np.sin(np.arange(200) / 20)[20:-20]).max() < 0.1


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from prospect.streaming.monitor import watch

    rows = spark.range(20).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 2 == 0).alias("g"), F.col("id").cast("double").alias("y"))
    rows.write.parquet(f"file://{tmp_path}/in")
    q = watch(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "ts", F.col("g"), "y").writeStream.format("memory").queryName("watched").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("select sum(n), sum(n_group) from watched").first()[:] == (20, 10)


def test_null_targets_are_no_members(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", None), ("b", 0.0), ("b", 0.0)], "g string, y double")
    predicates = [Equals(Attribute("g", Kind.CATEGORICAL), category=v) for v in "ab"]
    best = search.search(df, predicates, scores.MeanShift("y"), scores.MeanShiftBound("y"), 1, 1).best[0]
    assert best.n == 1 and abs(best.score - (10 - 10 / 3) / 3) < 1e-9


@pytest.mark.parametrize("exponent", [0.5, 1.0, 2.0])
def test_mean_shift_bounds_hold_for_every_subset(spark, exponent):
    rng = random.Random(31)
    y = [rng.gauss(0, 1) for _ in range(14)]
    sign = [i % 5 for i in range(14)]
    mean, (a, b) = sum(y) / 14, scores.MeanShift("y", exponent).powers
    group = [i for i in range(14) if i % 3]

    def score(m):
        return (len(m) / 14) ** a * max(sum(y[i] for i in m) / len(m) - mean, 0) ** b if m else 0.0

    subsets = [m for k in range(1, len(group) + 1) for m in itertools.combinations(group, k)]
    whole = [m for m in subsets if all(j in m for i in m for j in group if sign[j] == sign[i])]
    df = spark.createDataFrame([(v, s, i in group) for i, (v, s) in enumerate(zip(y, sign))], "y double, s int, g boolean")
    totals = scores.Totals.of(df, "y")
    for bound, of in ((scores.MeanShiftBound("y", exponent), subsets), (scores.GroupedMeanShiftBound("y", exponent), whole)):
        parts = bound.parts(totals)
        rows = df.where("g").groupBy("s").agg(F.count(F.lit(1)).alias("n"), *(getattr(F, how)(c).alias(k) for k, (c, how) in parts.items())).withColumns(bound.derived(totals))
        got = rows.agg(F.sum("n").alias("n"), *(getattr(F, how)(k).alias(k) for k, (_, how) in parts.items())).select(bound.value(totals).alias("b")).first()["b"]
        assert got >= max(map(score, of)) - 1e-9
        if exponent == 1.0:
            assert abs(got - max(map(score, of))) < 1e-9


@pytest.mark.parametrize("anomaly", [False, True])
@pytest.mark.parametrize("gamma", [0.5, 1.0])
def test_mmd_and_its_bounds_hold_for_every_subset(spark, anomaly, gamma):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    group = list(range(8))
    mean = x.mean(axis=0)

    def score(m):
        n, k = 12, len(m)
        f = k if anomaly else k * (n - k) / n
        return f ** (gamma - 2) * float(((x[list(m)].sum(axis=0) - k * mean) ** 2).sum())

    best = max(score(m) for k in range(1, 9) for m in itertools.combinations(group, k))
    df = spark.createDataFrame([(i, v, "in" if i in group else "out") for i, v in enumerate(x.tolist())], "i long, x array<double>, g string")
    totals = scores.Totals.of(df, "x")
    got = {}
    for s in (scores.Mmd("x", gamma, anomaly), scores.MmdBound("x", gamma, anomaly)):
        parts = s.parts(totals)
        got[type(s)] = df.where("g = 'in'").agg(F.count(F.lit(1)).alias("n"), *(getattr(F, how)(c).alias(k) for k, (c, how) in parts.items())).select(s.value(totals).alias("v")).first()["v"]
    assert abs(got[scores.Mmd] - score(group)) < 1e-9 and got[scores.MmdBound] >= best - 1e-9
    near = {r["g"]: r["bound"] for r in kernels.mean_deviation_bound(df, "x", "g", gamma, anomaly).collect()}
    values, vectors = kernels.spectrum(x @ x.T, 3)
    mask = np.array([i in group for i in range(12)])
    assert near["in"] >= best - 1e-9 and abs(near["in"] - kernels.mmd_bound(values, vectors, mask, gamma, anomaly)) < 1e-6
    by = {r["g"]: r["score"] for r in kernels.mean_deviation(df, "i", "x", "g", kernels.linear(), gamma, anomaly).collect()}
    assert abs(by["in"] - score(group)) < 1e-9


def test_mmd_search_with_a_kernel(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(4, 0.3, (10, 2))])
    df = spark.createDataFrame([(i, v, "far" if i >= 30 else "ab"[i % 2], i % 4 == 0) for i, v in enumerate(x.tolist())], "i long, x array<double>, g string, f boolean")
    done = Computation().load_dataset(df, "x", {"i": "index"}).load_prediciser(2, negate="BOOLEAN").load_language("closure-conjunctions").load_kernel("rbf", sigma=2.0).compute_gramian("i", 40).load_measure("mmd").load_optimistic_estimator("mmd-sd").optimise(2, 2)
    assert "far" in done.result.best[0].text and done.result.best[0].n == 10
    k = kernels.matrix(x, x, kernels.rbf(2.0))
    values, vectors = kernels.spectrum(k)
    assert abs(done.result.best[0].score - kernels.mmd(values, vectors, np.arange(40) >= 30)) < 1e-6


def test_search_goes_on_from_where_it_stopped(toy):
    df, predicates = toy
    how = (scores.MeanShift("y"), scores.MeanShiftBound("y"), 4)
    short = search.search(df, predicates, *how, 1)
    assert short.status == "stopped"
    whole, rest = search.search(df, predicates, *how, 3), search.search(df, predicates, *how, 2, resume=short)
    assert [f.indices for f in rest.best] == [f.indices for f in whole.best]


def test_scores_from_text():
    assert scores.from_text("coverage-mean-shift(0.5)", "y") == scores.MeanShift("y", 0.5)
    assert scores.from_text("mmd(gamma=0.5, anomaly=True)", "x") == scores.Mmd("x", 0.5, True)
    both = scores.from_text("coverage jaccard [1, 2]", "t")
    assert both.exponents == (1.0, 2.0) and both.scores == (scores.Coverage("t"), scores.Jaccard("t"))
    with pytest.raises(ValueError):
        scores.from_text("nothing")


def test_kernel_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(30, None)], "id long, x array<double>")
    known, k = df.where("x is not null"), kernels.matrix(x, x, kernels.rbf(2.0))
    f = np.array([r["features"] for r in kernels.features(df, "id", "x", kernels.rbf(2.0), 100).orderBy("id").collect()][:30])
    assert np.allclose(f @ f.T, k, atol=1e-6)
    gram = kernels.gram(known, "id", "x", kernels.rbf(2.0))
    v = spark.createDataFrame([(i, float(i)) for i in range(30)], "i long, v double")
    got = {r["i"]: r["v"] for r in kernels.times_vector(gram, v).collect()}
    assert np.allclose([got[i] for i in range(30)], k @ np.arange(30.0))
    assert kernels.sub_matrix(gram, v.where("i < 5")).count() == 15
    both = {(r["i"], r["j"]): r["k"] for r in kernels.weighted_sum([(2.0, gram), (0.0, gram), (0.5, gram)]).collect()}
    assert abs(both[3, 7] - 2.5 * k[3, 7]) < 1e-9
    r = kernels.pair_sums(known, "id", "x", (kernels.linear(), kernels.rbf(2.0))).first()
    assert abs(r["ab"] - ((x @ x.T) * k).sum()) < 1e-6 and abs(r["bb"] - (k * k).sum()) < 1e-6
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(9, 3))
    got = alignment.low_rank_products(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a array<double>, b array<double>"), ["a", "b"])
    assert np.allclose(got, [[(u @ u.T * (w @ w.T)).sum() for w in (a, b)] for u in (a, b)])


def test_rows_by_place(spark, tmp_path):
    spark.range(0, 100, 1, 5).selectExpr("id", "id * 2 AS a").write.parquet(f"file://{tmp_path}/a")
    a = spark.read.parquet(f"file://{tmp_path}/a").orderBy("id")
    rows = ingest.beside(a, a.select((F.col("id") + 1000).alias("b"))).collect()
    assert len(rows) == 100 and all(r["b"] == r["id"] + 1000 for r in rows)
    assert sorted((r["id"], r["orig_idx"]) for r in ingest.row_slice(a, 10, 13).collect()) == [(10, 10), (11, 11), (12, 12)]
    odd = spark.createDataFrame([("1", '{"k": 1}'), ("x", "{"), (None, None)], "s string, j string")
    got = ingest.json_fields(ingest.typed(odd, {"s": "int"}), "j", {"k": "long"}).collect()
    assert [(r["s"], r["k"]) for r in got] == [(1, 1), (None, None), (None, None)]


def test_graph_distance_and_predicates_on_some_row(spark, toy):
    labels = spark.createDataFrame([(g, v, 0, lab) for g, ls in (("p", "aab"), ("q", "abb"), ("r", "cc")) for v, lab in enumerate(ls)], "graph string, vid int, round int, label string")
    got = {(r["a"], r["b"]): round(r["distance"], 6) for r in graphs.label_distance(labels, "graph").collect()}
    assert got == {("p", "q"): round(1 / 3, 6), ("p", "r"): 1.0, ("q", "r"): 1.0}
    df, predicates = toy
    table = language.compress(df, predicates, {})
    for i, found in enumerate(language.on_some_row(table, [(0,), ()], len(predicates))):
        of = df.where(predicates[0].column()) if i == 0 else df
        assert found == tuple(j for j, p in enumerate(predicates) if of.where(p.column()).count())


def test_matrix_text(spark, tmp_path):
    (tmp_path / "sparse.txt").write_text("@matrix edges\n@data type=sparse order=columns\n1 (1,2,5) 5,4,2\n3 (2,4-5) 20,?,90\n@end data\n@end matrix edges\n")
    got = sorted((r["i"], r["j"], r["v"]) for r in readers.load(spark, f"matrix:file://{tmp_path}/sparse.txt").collect() if r["v"] is not None)
    assert got == [(0, 0, 5.0), (1, 0, 4.0), (1, 2, 20.0), (4, 0, 2.0), (4, 2, 90.0)]
    (tmp_path / "dense.txt").write_text("@matrix m\n@data type=dense order=rows\n0,2,3\n3,?,3\n@end data\n@end matrix m\n")
    got = {(r["i"], r["j"]): r["v"] for r in readers.load(spark, f"matrix:file://{tmp_path}/dense.txt").collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 3.0, (1, 1): None, (1, 2): 3.0}
    rng = random.Random(4)
    cells = {(rng.randrange(30), rng.randrange(5)): rng.random() for _ in range(80)}
    entries = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "i long, j long, v double")
    for sparse in (True, False):
        texts.write_matrix(entries, f"file://{tmp_path}/w{sparse}", "m", sparse)
        got = {(r["i"], r["j"]): r["v"] for r in texts.matrix(spark, f"file://{tmp_path}/w{sparse}").collect()}
        assert {at: v for at, v in got.items() if v} == cells
    assert any("-" in line for f in (tmp_path / "wTrue").glob("part-*") for line in f.read_text().splitlines())
    texts.write_matrix(entries.limit(0), f"file://{tmp_path}/none", "m")
    assert texts.matrix(spark, f"file://{tmp_path}/none").count() == 0


def test_relation_text(spark, tmp_path):
    (tmp_path / "r.txt").write_text("@relation people\n@columns age name tall\n@attribute (1) numeric storage=int\n@attribute (2) categorical\n@attribute (3) boolean\n@data type=dense order=columns\n1 30,?,x\n2 ann,bob,cy\n3 true,false,true\n@end data\n@end relation people\n")
    want = [(None, "bob", False), (None, "cy", True), (30, "ann", True)]
    found = readers.load(spark, f"relation:file://{tmp_path}/r.txt")
    assert found.dtypes == [("age", "bigint"), ("name", "string"), ("tall", "boolean")]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1:]) == sorted(want, key=lambda r: r[1:])
    texts.write_relation(found, f"file://{tmp_path}/w", "people")
    back = texts.relation(spark, f"file://{tmp_path}/w")
    assert back.dtypes == found.dtypes and sorted(map(tuple, back.collect()), key=lambda r: r[1:]) == sorted(want, key=lambda r: r[1:])
    (tmp_path / "d.txt").write_text("first {a^b}\nnone\n{c} and {}\n")
    assert [tuple(r) for r in texts.descriptions(spark, f"file://{tmp_path}/d.txt").collect()] == [(0, "{a^b}"), (2, "{c}"), (2, "{}")]


def test_packed_kernels_as_rows(spark, tmp_path):
    import struct

    ids, values = [7, 3, 9], [1, 2, 3, 4, 5, 6]
    (tmp_path / "k.bin").write_bytes(struct.pack(">I", 3) + struct.pack("<3Q", *ids) + bytes(values))
    got = sorted((r["i"], r["j"], r["k"]) for r in texts.packed_kernels(spark, f"file://{tmp_path}/k.bin").collect())
    assert got == [(3, 3, 4.0), (3, 9, 5.0), (7, 3, 2.0), (7, 7, 1.0), (7, 9, 3.0), (9, 9, 6.0)]


def test_scalar_targets_and_smoothing(spark):
    x = np.array([[1.0, -2.0], [3.0, 0.0], [-1.0, 5.0]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(3, None)], "id int, y array<double>")
    get = lambda how, p=None: [r[-1] for r in ingest.scalar_target(df, "y", how, p).orderBy("id").collect()]
    assert get("component", 1) == [-2.0, 0.0, 5.0, None]
    assert np.allclose(get("norm")[:3], np.linalg.norm(x, axis=1)) and get("norm", float("inf")) == [2.0, 3.0, 5.0, None]
    assert np.allclose(get("centred-norm", 3)[:3], np.linalg.norm(x - x.mean(axis=0), 3, axis=1))
    assert ingest.scalar_target(df, "y", "attribute", 0).columns == ["id"]
    with pytest.raises(ValueError):
        ingest.scalar_target(df, "y", "norm", 0.5)
    long = np.random.default_rng(2).normal(size=50).tolist()
    rows = ingest.low_passed(spark.createDataFrame([(long,), ([],), (None,)], "v array<double>"), "v", 0.2).collect()
    assert np.allclose(rows[0]["smooth"], ingest.low_pass(long, 0.2)) and rows[1]["smooth"] == [] and rows[2]["smooth"] is None


def test_learnt_kernels(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(30, None)], "id long, x array<double>")
    features, sigmas, target = {"a": [0], "b": [1, 2]}, [0.5, 1.0, 3.0], kernels.rbf(2.0)
    t = kernels.matrix(x, x, target)
    align = lambda k: (k * t).sum() / np.sqrt((k * k).sum() * (t * t).sum())
    of = {(n, s): kernels.matrix(x[:, at], x[:, at], kernels.rbf(s)) for n, at in features.items() for s in sigmas}
    got = {(r["feature"], r["sigma"]): r["alignment"] for r in learning.widths(df.where("x is not null"), "id", "x", learning.grid(features, sigmas), target).collect()}
    assert got.keys() == of.keys() and all(abs(got[k] - align(of[k])) < 1e-9 for k in of)
    parts = learning.learn(df, "id", "x", features, sigmas, target)
    best = [max(sigmas, key=lambda s: align(of[n, s])) for n in features]
    assert [p.sigma for p in parts] == best
    ks = [of[n, s] for n, s in zip(features, best)]
    assert np.allclose([p.weight for p in parts], alignment.coefficients(*alignment.frobenius(ks, t)))
    whole = sum(p.weight * k for p, k in zip(parts, ks))
    rows = learning.final_gram(df, "id", "x", parts).collect()
    assert len(rows) == 30 * 31 // 2 and all(abs(r["k"] - whole[r["i"], r["j"]]) < 1e-9 for r in rows)
    held = rng.random((30, 4)) < 0.4
    sets = spark.createDataFrame([(i, v, np.flatnonzero(h).tolist()) for i, (v, h) in enumerate(zip(x.tolist(), held))], "id long, x array<double>, on array<int>")
    sums = learning.set_sums(sets, "id", "x", "on", 4, [parts[1]])
    s = held.T.astype(float) @ ks[1] @ held
    m = (held.T @ ks[1]).sum(axis=1)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(held.sum(axis=0))], "a int, n long")
    n = held.sum(axis=0)
    want = {"tanimoto": s / (m[:, None] + m[None, :] - s), "normalised": s / np.sqrt(np.outer(np.diag(s), np.diag(s))), "mean-map": s / np.outer(n, n)}
    for how, k in want.items():
        got = learning.set_kernel(sums, how, sizes).collect()
        assert len(got) == 16 and all(abs(r["k"] - k[r["a"], r["b"]]) < 1e-9 for r in got)


def test_group_measures(spark):
    # two triangles joined by an edge, a tail, and a group without edges
    pairs = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4), (6, 7), (2, 1), (1, 1)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    members = spark.createDataFrame([("l", v) for v in (1, 2, 3)] + [("r", v) for v in (4, 5, 6, 7)] + [("n", 1), ("n", 7)], "group string, vid int")
    got = {r["group"]: r for r in graphs.group_measures(edges, members).collect()}
    left, right, none = got["l"], got["r"], got["n"]
    assert (left["n_edges"], left["edge_vertex_ratio"], left["mean_coreness"], left["max_coreness"]) == (3, 1.0, 2.0, 2)
    assert abs(left["inverse_conductance"] - (1 - 1 / 7)) < 1e-12 and abs(left["local_modularity"] - (3 / 8 - (7 / 16) ** 2)) < 1e-12
    assert (right["n_edges"], right["mean_coreness"]) == (4, 7 / 4) and (none["n_edges"], none["max_coreness"], none["inverse_conductance"]) == (0, 0, 0.0)


def test_search_keeps_history_and_tree(toy):
    df, predicates = toy
    found = search.search(df, predicates, scores.MeanShift("y"), scores.MeanShiftBound("y"), 3, 3, keep_tree=True)
    kept: list = []
    for u in found.history:
        kept = [f for f in kept if u.old is None or f.indices != u.old.indices] + [u.new]
    assert {f.indices for f in kept} == {f.indices for f in found.best}
    assert search.history_frame(found, df).count() == len(found.history) == found.stats["added"]
    tree = search.tree_frame(found, df, predicates)
    assert tree.count() == len({c for _, c, _ in found.tree}) and all(set(a) < set(b) for a, b, _ in found.tree)
    expanded = {c for _, c, on in found.tree if on} | {()}
    assert {a for a, _, _ in found.tree} <= expanded
    more = {r["rank"]: r["cover"] for r in search.with_scores(found, df, predicates, {"cover": scores.Coverage()}).collect()}
    assert more == {i + 1: round(f.n / 120, 6) for i, f in enumerate(found.best)}
    sizes = {r["group"]: r["count"] for r in search.members(found, df, predicates, "d").groupBy("group").count().collect()}
    assert sizes == {i + 1: f.n for i, f in enumerate(found.best)}
    back = summary.from_json(summary.to_json(found))
    assert back.best == found.best and back.gap == found.gap and summary.to_json(back) == summary.to_json(found)


def test_closed_refinements_and_parents(toy):
    df, predicates = toy
    held, _ = _table(df, predicates)
    table, p = language.compress(df, predicates, {}), len(predicates)
    root = language.closures(table, [()], p)[0][1]
    got = language.closed_refinements(table, root, p)
    want: dict = {}
    for i in range(p):
        rows = held[:, i]
        if i not in root and rows.any():
            want.setdefault(tuple(int(j) for j in np.flatnonzero(held[rows].all(axis=0))), (i, int(rows.sum())))
    assert {of: (i, n) for i, n, of in got} == want and [n for _, n, _ in got] == sorted(n for _, n, _ in got)
    assert language.closed_parent(table, root, p) is None
    for _, _, of in got[:4]:
        parent = language.closed_parent(table, of, p)
        assert set(parent) < set(of)
