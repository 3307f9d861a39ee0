"""Files with cells that don't convert, graph sets with labels and attributes of edges, graph kernels, numbered rows."""

import numpy as np
import pytest

from prospect.operators import graphs, ingest
from prospect.sources import readers


def test_declared_tables_with_bad_cells(spark, tmp_path):
    (tmp_path / "t.dat").write_text("@relation t\n@attribute a integer [1, 9]\n@attribute b real [0, 1]\n@attribute c {x, y}\n@data\n1, 0.5, x\nbad, 0.25, y\n3, none, <null>\n?, 1e3, x\n")
    got = [tuple(r) for r in readers.load(spark, f"keel:{tmp_path}/t.dat").collect()]
    assert sorted(got, key=str) == sorted([(1, 0.5, "x"), (None, 0.25, "y"), (3, None, None), (None, 1000.0, "x")], key=str)


def test_graph_sets_with_labels_and_attributes(spark, tmp_path):
    files = {"A": "1, 2\n2, 1\n3, 4\n", "graph_indicator": "1\n1\n2\n2\n", "graph_labels": "1\n-1\n", "node_labels": "5\n6\n7\n8\n", "node_attributes": "0.5, 1\n2, bad\n3, 4\n5, 6\n", "edge_labels": "9\n4\n2\n", "edge_attributes": "1.5\n2.5\n3.5\n"}
    for name, text in files.items():
        (tmp_path / f"g_{name}.txt").write_text(text)
    v, e, t = readers.graphs(spark, str(tmp_path), "g")
    assert sorted(map(tuple, v.collect())) == [(1, 0, 5, [0.5, 1.0]), (1, 1, 6, [2.0, None]), (2, 0, 7, [3.0, 4.0]), (2, 1, 8, [5.0, 6.0])]
    assert sorted(map(tuple, e.collect())) == [(1, 0, 1, 9, [1.5]), (1, 1, 0, 4, [2.5]), (2, 0, 1, 2, [3.5])]
    assert sorted(map(tuple, t.collect())) == [(1, 1), (2, -1)]
    _, both, _ = readers.graphs(spark, str(tmp_path), "g", both_ways=True)
    assert sorted(map(tuple, both.collect())) == [(1, 0, 1, 4, [1.5]), (1, 1, 0, 4, [1.5]), (2, 0, 1, 2, [3.5]), (2, 1, 0, 2, [3.5])]


def transport(cost, rounds=4000, step=0.02):
    """The least cost of matching equally many equal masses, over all matchings."""
    import itertools

    n = len(cost)
    return min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n


def test_graph_kernel_is_the_best_transport_of_labels(spark):
    rng = np.random.default_rng(9)
    rows, edges = [], []
    for g in range(4):
        for v in range(6):
            rows.append((10 * g + v, f"g{g}", "ab"[int(rng.integers(0, 2))]))
        edges += [(10 * g + a, 10 * g + b) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.4]
    edges += [(0, 11), (12, 35)]  # between graphs
    vertices = spark.createDataFrame(rows, "vid long, graph string, label string")
    links = spark.createDataFrame(edges, "src long, dst long")
    found = {(r["a"], r["b"]): r["k"] for r in graphs.wl_kernel(vertices, links, "graph", rounds=2, gamma=1.5).collect()}
    inside = spark.createDataFrame([e for e in edges if e[0] // 10 == e[1] // 10], "src long, dst long")
    tuples = {}
    for r in graphs.wl_labels(inside, vertices.select("vid", "label"), 2).collect():
        tuples.setdefault(r["vid"], {})[r["round"]] = r["label"]
    for a in range(4):
        for b in range(a, 4):
            cost = [[sum(tuples[10 * a + i][r] != tuples[10 * b + j][r] for r in range(3)) / 3 for j in range(6)] for i in range(6)]
            assert abs(found[f"g{a}", f"g{b}"] - np.exp(-1.5 * transport(cost))) < 1e-9
    assert len(found) == 10


@pytest.mark.parametrize("n", [0, 1, 50])
def test_numbered_rows_after_a_sort(spark, n):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(n)], "v int").repartition(5).orderBy("v")
    got = sorted((r["position"], r["v"]) for r in ingest.numbered(df).collect())
    assert got == list(enumerate(sorted(i * 37 % 101 for i in range(n))))
