"""Graph loops send no table of the vertices through the driver, however small it looks."""

from prospect.operators import graphs


def test_vertices_are_joined_by_sorting(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    kept = graphs._cut
    monkeypatch.setattr(graphs, "_cut", seen)
    edges = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)] + [(4, 5), (5, 6)], "src long, dst long")
    assert {r["vid"]: r["core"] for r in graphs.coreness(edges).collect()} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1, 6: 1}
    rounds = len(plans)
    labels = spark.createDataFrame([(v, "a") for v in range(7)], "vid long, label string")
    out = graphs.wl_labels(edges, labels, 2)
    assert out.count() == 21 and len(plans) > rounds
    assert not any("Broadcast" in p for p in plans)
    # the edges both ways are written once, not made again in every round
    assert sum("Union" in p for p in plans[rounds:]) == 1
