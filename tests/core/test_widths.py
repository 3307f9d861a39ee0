"""Widths that a surrogate proposes against fine grids."""

import numpy as np

from prospect.operators import kernels, learning


def test_proposed_widths_align_as_well_as_a_fine_grid(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3)) * [1.0, 4.0, 0.3]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)] + [(99, None)], "id long, x array<double>")
    features = {"a": [0], "b": [1], "ac": [0, 2]}
    target = kernels.rbf(2.0)
    t = kernels.matrix(x, x, target)

    def alignment(at, sigma):
        k = kernels.matrix(x[:, at], x[:, at], kernels.rbf(sigma))
        return float((k * t).sum() / np.sqrt((k * k).sum() * (t * t).sum()))

    tried = learning.search_widths(df, "id", "x", features, 0.1, 20.0, target)
    grid = np.exp(np.linspace(np.log(0.1), np.log(20.0), 60))
    for name, at in features.items():
        assert len(tried[name]) <= 11
        assert all(abs(v - alignment(at, s)) < 1e-9 for s, v in tried[name].items())
        assert max(tried[name].values()) >= max(alignment(at, s) for s in grid) - 1e-3
    assert learning.search_widths(df, "id", "x", {}, 0.1, 20.0, target) == {}


def test_a_flat_surrogate_proposes_nothing():
    assert learning._propose([0.0, 0.5, 1.0], [0.4, 0.4, 0.4], 0.0, 1.0, 2, 1e-5) == []
    found = learning._propose([0.0, 0.5, 1.0], [0.1, 0.5, 0.3], 0.0, 1.0, 2, 1e-5)
    assert len(found) == 2 and 0.5 < found[0] < 1.0 and len(set(found)) == 2
