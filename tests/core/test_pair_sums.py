"""Sums over all pairs of rows, by series and by pairs of blocks with several tiles, against whole matrices."""

import numpy as np
import pytest

from prospect.operators import alignment, kernels, learning, spectra


@pytest.mark.parametrize("tile, grid", [(4, 2), (7, 24)])
def test_blocks_of_several_tiles(spark, monkeypatch, tile, grid):
    for m in (kernels, spectra, learning, alignment):
        monkeypatch.setattr(m, "BLOCK", tile)
    monkeypatch.setattr(kernels, "GRID", grid)
    rng = np.random.default_rng(11)
    x, null = rng.normal(size=(40, 3)), rng.normal(size=(40, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), null[i].tolist(), i % 3) for i in range(40)], "id long, x array<double>, n array<double>, g int")
    for kernel in (kernels.linear(), kernels.rbf(1.5)):
        k = kernels.matrix(x, x, kernel)
        d = np.sqrt(np.diag(k))
        got = {(r["i"], r["j"]): r["k"] for r in kernels.gram(df, "id", "x", kernel, normalise=True).collect()}
        assert len(got) == 40 * 41 // 2 and all(abs(k[i, j] / (d[i] * d[j]) - v) < 1e-9 for (i, j), v in got.items())
        sums = {(r["ga"], r["gb"]): r["s"] for r in kernels.group_sums(df, "id", "x", "g", kernel).collect()}
        assert all(abs(sums[str(a), str(b)] - k[a::3, b::3].sum()) < 1e-9 for a in range(3) for b in range(3))
        left = spectra.without(df, "id", "x", kernel, "n", 2)
        got, want = {(r["i"], r["j"]): r["k"] for r in left.collect()}, kernels.without(k, null)
        assert len(got) == 1600 and all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(40) for j in range(40))


def test_rows_are_dealt_to_no_more_blocks_as_they_grow(spark):
    # before, each row went to n / 512 pairs of blocks
    df = spark.range(100_000).withColumn("x", kernels.F.array(kernels.F.lit(1.0)))
    blocks = kernels.blocks_of(df, "x", 512)
    assert blocks == kernels.GRID
    dealt = kernels._pairs(df.where("id < 100"), "id", "x", [], blocks)
    assert dealt.count() == 100 * (blocks + 1)


def test_entities_of_any_key_and_class(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 5)
    rng = np.random.default_rng(12)
    sets = [sorted(set(rng.integers(0, 6, size=rng.integers(0, 4)).tolist())) for _ in range(30)] + [[1, 1, 2], None]
    for kind, key in (("int", int), ("string", lambda i: f"k{i:02}")):
        df = spark.createDataFrame([(key(i), s) for i, s in enumerate(sets)], f"id {kind}, on array<int>")
        for most in (1 << 22, 0):
            monkeypatch.setattr(alignment, "HELD", most)
            got = alignment.entity_similarity(df, "id", "on")
            assert dict(got.dtypes) == {"i": kind, "j": kind, "k": "double"}
            want = {
                (key(i), key(j)): len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5
                for i, a in enumerate(sets) for j, b in enumerate(sets) if i <= j and a and b and set(a) & set(b)
            }
            found = {(r["i"], r["j"]): r["k"] for r in got.collect()}
            assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


@pytest.mark.parametrize("kernel", [kernels.linear(), kernels.rbf(2.0)])
def test_series_against_matrices(spark, monkeypatch, kernel):
    monkeypatch.setattr(learning, "LEAST", 1 << 19)  # series, however many terms
    monkeypatch.setattr(learning, "_pairs", None)  # no pair of rows
    rng = np.random.default_rng(13)
    x = rng.uniform(-0.5, 0.5, size=(60, 4)) + 3.0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    parts = learning.grid({"a": [0], "all": [0, 1, 2, 3]}, [0.5, 2.0])
    of = [p.matrix(x, x) for p in parts]
    t = kernels.matrix(x, x, kernel)
    w, v, tt = learning.products(df, "id", "x", parts, kernel)
    assert np.allclose(w, [[(a * b).sum() for b in of] for a in of], rtol=1e-10) and np.allclose(v, [(a * t).sum() for a in of], rtol=1e-10) and abs(tt / (t * t).sum() - 1) < 1e-10
    held = rng.random((60, 3)) < 0.4
    sets = spark.createDataFrame([(i, v, np.flatnonzero(h).tolist()) for i, (v, h) in enumerate(zip(x.tolist(), held))], "id long, x array<double>, on array<int>")
    full = np.column_stack([held, np.ones(60)])
    got = learning.set_sums(sets, "id", "x", "on", 3, parts).collect()
    assert len(got) == 4 * 16
    assert all(abs(r["s"] - full[:, r["a"]] @ of[r["part"]] @ full[:, r["b"]]) < 1e-8 for r in got)


def test_rows_are_written_once_however_many_pairs(spark, monkeypatch):
    # before, each row was shuffled to every pair of blocks with its own
    import glob

    from prospect.sources.scratch import shared_folder

    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v, [i % 7, 7 + i % 2]) for i, v in enumerate(x.tolist())], "id long, x array<double>, on array<int>")
    for m in (kernels, spectra, alignment):
        monkeypatch.setattr(m, "BLOCK", 100)
    folder = shared_folder(spark).removeprefix("file://")
    files = set(glob.glob(f"{folder}/blocks-*/*"))
    for made, bytes_ in (
        (lambda: kernels.gram(df, "id", "x", kernels.linear(), digits=6), x.nbytes), (lambda: kernels.gram(df, "id", "x", kernels.linear(), normalise=True, digits=6), x.nbytes), (lambda: kernels.gram(df, "id", "x", kernels.rbf(1.0), digits=6), x.nbytes),
        (lambda: spectra.without(df.withColumn("n", kernels.F.array(kernels.F.lit(1.0))), "id", "x", kernels.linear(), "n", 1, digits=6), x.nbytes), (lambda: alignment.entity_similarity(df, "id", "on", digits=6), x.nbytes // 8),
    ):
        out = made()
        new = set(glob.glob(f"{folder}/blocks-*/*")) - files
        files |= new
        assert len(new) == kernels.GRID and sum(len(open(f, "rb").read()) for f in new) < 1.5 * bytes_ + 4000 * 32 + 24 * 2000
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["i"], r["j"]): r["k"] for r in kernels.gram(df.where("id < 900"), "id", "x", kernels.linear(), digits=6).where("i % 50 = 0").collect()}
    assert len(got) == sum(900 - i for i in range(0, 900, 50)) and all(abs(v - x[i] @ x[j]) < 5.1e-7 for (i, j), v in got.items())
    assert kernels.rounded(np.array([-1e-9, 0.0000015, -2.5, np.inf]), 6).tolist() == [0.0, 0.000002, -2.5, np.inf] and not np.signbit(kernels.rounded(np.array([-1e-9]), 6)[0])
