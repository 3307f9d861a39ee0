"""Coreness by blocks of vertices against peeling by hand, for any keys and groups, and what a round sends."""

import numpy as np
import pytest

from prospect.functions.discretise import Interval
from prospect.functions.predicates import Attribute, Equals, Kind, Ranged
from prospect.operators import cores, graphs, scores, search


def peeled(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        out[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return out


def made(n, m, seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(0, n, size=(m, 2)) ** 2 // n * 5 - 3]  # some meet more often, some numbers are negative


@pytest.mark.parametrize("least, grid, ends", [(1 << 18, 24, 1 << 21), (30, 5, 1 << 21), (30, 2, 90), (30, 5, 3)])
def test_coreness_by_blocks(spark, monkeypatch, least, grid, ends):
    for name, value in (("LEAST", least), ("GRID", grid), ("ENDS", ends)):
        monkeypatch.setattr(cores, name, value)
    pairs = made(60, 300, 1)
    want = peeled(pairs)
    for kind, key in (("long", int), ("int", int), ("string", lambda v: f"k{v}")):
        got = graphs.coreness(spark.createDataFrame([(key(a), key(b)) for a, b in pairs + [(b, a) for a, b in pairs[:40]]], f"src {kind}, dst {kind}"))
        assert dict(got.dtypes)["vid"] == dict(got.sparkSession.createDataFrame([], f"vid {kind}").dtypes)["vid"]
        assert {r["vid"]: r["core"] for r in got.collect()} == {key(v): c for v, c in want.items()}
    groups = {"a": pairs, "b": made(9, 30, 2), "c": [(1, 2)]}
    rows = [(g, *e) for g, of in groups.items() for e in {(min(e), max(e)) for e in of if e[0] != e[1]}]
    got = {r["group"]: [(s["core"], s["n"]) for s in r["shells"]] for r in graphs.induced_shells(spark.createDataFrame(rows, "group string, src long, dst long")).collect()}
    assert got == {g: sorted(((c, list(p.values()).count(c)) for c in set(p.values())), reverse=True) for g, p in ((g, peeled(of)) for g, of in groups.items())}
    assert graphs.coreness(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


def test_a_round_sends_values_between_blocks(spark, monkeypatch):
    # before, every round joined all ends of edges with the vertices
    monkeypatch.setattr(cores, "LEAST", 400)
    monkeypatch.setattr(cores, "GRID", 4)
    plans, tables, kept = [], [], cores.cut

    def seen(df, what):
        if what == "cores":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            tables.append(kept(df, what))
            return tables[-1]
        return kept(df, what)

    monkeypatch.setattr(cores, "cut", seen)
    pairs = made(200, 4000, 3)
    assert {r["vid"]: r["core"] for r in graphs.coreness(spark.createDataFrame(pairs, "src long, dst long")).collect()} == peeled(pairs)
    assert len(tables) > 2 and not any("Join" in p for p in plans[1:])
    assert all(t.count() <= 16 for t in tables)


def test_the_whole_graph_is_rated_by_the_coreness_that_is_there(spark, monkeypatch):
    calls, kept = [], cores.cores
    monkeypatch.setattr(cores, "cores", lambda edges: calls.append(1) or kept(edges))
    pairs = made(40, 120, 4)
    ids = sorted({v for e in pairs for v in e})
    rows = spark.createDataFrame([(v, "xyz"[i % 3]) for i, v in enumerate(ids)], "vid long, c string")
    predicates = [*(Equals(Attribute("c", Kind.CATEGORICAL, position=0), category=v) for v in "xyz"), Ranged(Attribute("core", Kind.NUMERICAL, position=1), interval=Interval(4.0, None, name="from 4"))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    core = peeled(pairs)

    def value(members):
        return len(members) / len(ids) * sum(peeled([e for e in pairs if set(e) <= members]).values()) / max(1, len(members))

    groups = {(): set(ids), **{(j,): {v for i, v in enumerate(ids) if i % 3 == j} for j in range(3)}, (3,): {v for v in ids if core.get(v, 0) >= 4}}
    for used in (predicates[:3], predicates):  # the last asks for the coreness itself
        calls.clear()
        found = search.search(rows, used, scores.AverageCoreness(), scores.InducedAverageCoreness(), 10, 1, edges=edges)
        want = {c: (len(m), round(value(m), 6)) for c, m in groups.items() if all(j < len(used) for j in c)}
        assert {f.indices: (f.n, round(f.score, 6)) for f in found.best} == want
        assert len(calls) == 2
