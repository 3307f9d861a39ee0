"""Kernels learnt from parts: a width for each feature, a weight for each feature's kernel, and their sum.

A feature is a list of components of a vector. All features and widths are rated
at once, and no matrix is written before the final kernel.

Sums over all pairs of rows of Gaussian kernels of few components need no pair: such
a kernel is the dot product of two rows' terms of the exponential's series, as far
as it goes before the rest is below ``REST``; so the sum of its values is the square of the
summed terms, and that of its products with the linear kernel the squares of the
terms' products with the vectors. Where a kernel is too narrow for
the spread of the rows, so that it would take too many terms, and for other kernels,
pairs of blocks are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment
from .kernels import BLOCK, _pairs, blocks_of, matrix, moments, rbf, sided, tiles, upper


@dataclass(frozen=True)
class SubKernel:
    """The Gaussian kernel of one feature, with its weight in the sum."""

    feature: str
    components: tuple[int, ...]
    sigma: float
    weight: float = 1.0

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = list(self.components)
        return matrix(x[:, at], y[:, at], rbf(self.sigma))


def grid(features: dict[str, list[int]], sigmas: list[float]) -> list[SubKernel]:
    return [SubKernel(name, tuple(at), float(s)) for name, at in features.items() for s in sigmas]


#: What a series may leave out of a kernel's value, the terms that a kernel may have (as many as there are rows, or ``LEAST``, at most), and the numbers of these times a vector's length.
REST, TERMS, NUMBERS, LEAST = 1e-16, 1 << 19, 1 << 23, 1 << 10
#: Terms of a group when they are added up.
CHUNK = 256


def _scales(kernel: SubKernel | dict, width: int) -> dict[int, float] | None:
    """The factor of each component's squared difference in a Gaussian kernel's exponent; none for other kernels."""
    if isinstance(kernel, SubKernel):
        return {c: 1 / (2 * kernel.sigma**2) for c in kernel.components}
    return {c: 1 / (2 * kernel["sigma"] ** 2) for c in range(width)} if kernel["kind"] == "gaussian" else None


def _degree(reach: float) -> int:
    """How far the series of exp(u'v - |u|^2 / 2 - |v|^2 / 2) goes until the rest is below ``REST``, for |u|^2 and |v|^2 up to ``reach``."""
    p = math.ceil(reach)
    while -reach + (p + 1) * math.log(max(reach, 1e-300)) - math.lgamma(p + 2) - math.log(1 - reach / (p + 2)) > math.log(REST):
        p += 1
    return p


def _series(z: np.ndarray, degree: int) -> np.ndarray:
    """Terms whose dot products are exp(-|u - v|^2 / 2): all monomials up to the degree, over the roots of their exponents' factorials."""
    last = np.exp(-(z * z).sum(axis=1) / 2)[:, None]
    out, end, power = [last], np.array([-1]), np.array([0])
    for _ in range(degree):
        # of a degree those with c as their last component come from all of the degree below whose last is c or earlier
        made = []
        for c in range(z.shape[1]):
            m = int((end <= c).sum())
            e = np.where(end[:m] == c, power[:m] + 1, 1)
            made.append((last[:, :m] * z[:, c : c + 1] / np.sqrt(e), np.full(m, c), e))
        last, end, power = (np.concatenate([x[i] for x in made], axis=-1) for i in range(3))
        out.append(last)
    return np.concatenate(out, axis=1)


@dataclass(frozen=True)
class _Series:
    """The series of one Gaussian kernel: components, their middles, the roots of their scales, the degree."""

    at: tuple[int, ...]
    middle: tuple[float, ...]
    scale: tuple[float, ...]
    degree: int

    @property
    def terms(self) -> int:
        return math.comb(len(self.at) + self.degree, self.degree)

    def of(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        step = max(1, (1 << 21) // self.terms)
        for a in range(0, len(x), step):
            yield slice(a, a + step), _series((x[a : a + step, list(self.at)] - self.middle) * self.scale, self.degree)


def _serial(df: DataFrame, x: str, width: int, scales: list[dict[int, float] | None]) -> list[_Series | None]:
    """The series of kernels with the given scales; none for one that would take too many terms."""
    some = [s for s in scales if s is not None and len(s) <= 8 and all(c < width for c in s)]
    used = sorted({c for s in some for c in s})
    if not used:
        return [None] * len(scales)
    at = lambda c: F.get(x, F.lit(c)).cast("double")
    ends = df.agg(F.count(F.lit(1)).alias("n"), *(f(at(c)).alias(f"{n}{c}") for c in used for n, f in (("a", F.min), ("b", F.max)))).first()
    middle = {c: ((ends[f"a{c}"] or 0.0) + (ends[f"b{c}"] or 0.0)) / 2 for c in used}
    reach = df.agg(*(F.max(sum((F.lit(2 * w) * (at(c) - F.lit(middle[c])) ** 2 for c, w in s.items()), F.lit(0.0))).alias(str(i)) for i, s in enumerate(some))).first()
    by = {id(s): r or 0.0 for s, r in zip(some, reach)}
    out: list[_Series | None] = []
    for s in scales:
        r = by.get(id(s), math.inf)
        # beyond that a row's terms fall below the least numbers; NaN and infinite values have none
        made = _Series(tuple(s), tuple(middle[c] for c in s), tuple(math.sqrt(2 * w) for w in s.values()), _degree(r)) if r < 1e3 else None
        out.append(made if made and made.terms <= min(TERMS, max(LEAST, ends["n"])) else None)
    return out


def _vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1)


def _folded(summed: DataFrame, whole: bool) -> DataFrame:
    """(item, a, b, s): products of terms (item, chunk, a, v) added up over tasks; ``whole``: only the sum of each with itself."""

    def fold(table: pa.Table) -> pa.Table:
        a, at = np.unique(table.column("a").to_numpy(), return_inverse=True)
        v = np.array(table.column("v").to_pylist(), float)
        total = np.zeros((len(a), v.shape[1]))
        np.add.at(total, at, v)
        s = np.array([[(total * total).sum()]]) if whole else total @ total.T
        i, j = np.indices(s.shape)
        of = np.zeros(1, int) if whole else a
        item = table.column("item")[0].as_py()
        return pa.table({"item": pa.array([item] * s.size, pa.int32()), "a": pa.array(of[i.ravel()], pa.int32()), "b": pa.array(of[j.ravel()], pa.int32()), "s": pa.array(s.ravel())})

    return summed.groupBy("item", "chunk").applyInArrow(fold, "item int, a int, b int, s double").groupBy("item", "a", "b").agg(F.sum("s").alias("s"))


def _handed(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(item, chunk, a, v) of a task's sums of terms."""
    for (item, a), v in found.items():
        cuts = [v[k : k + CHUNK] for k in range(0, len(v), CHUNK)]
        n = len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([a] * n, pa.int32()), pa.array(cuts, pa.list_(pa.float64()))], ["item", "chunk", "a", "v"])


_TERM_ROWS = "item int, chunk int, a int, v array<double>"


def pair_products(df: DataFrame, key: str, x: str, items: list[tuple[SubKernel | dict, SubKernel | dict]]) -> list[float]:
    """The Frobenius product of each two kernels over all pairs of rows: one number each, whatever the rows. The vectors are not null."""
    width = df.agg(F.coalesce(F.max(F.size(x)), F.lit(0))).first()[0]
    linear = [sum(not isinstance(k, SubKernel) and k["kind"] == "linear" for k in ks) for ks in items]
    scales = []
    for ks, n in zip(items, linear):
        own = [_scales(k, width) for k in ks if isinstance(k, SubKernel) or k["kind"] != "linear"]
        scales.append({c: sum(o.get(c, 0.0) for o in own) for c in sorted({c for o in own for c in o})} if n < 2 and all(o is not None for o in own) else None)
    series = [s if s is None or not n or s.terms * width <= NUMBERS else None for s, n in zip(_serial(df, x, width, scales), linear)]
    out = [0.0] * len(items)
    if 2 in linear:
        square = float((moments(df, x, width) ** 2).sum())
        out = [square if n == 2 else 0.0 for n in linear]
    serial = {i: s for i, s in enumerate(series) if s is not None}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = _vectors_of(batch) if batch.num_rows else np.zeros((0, width))
            for i, s in serial.items():
                for at, t in s.of(rows):
                    sums = rows[at].T @ t if linear[i] else t.sum(axis=0)[None]
                    for a, v in enumerate(sums):
                        found[i, a] = found[i, a] + v if (i, a) in found else v
        yield from _handed(found)

    if serial:
        for r in _folded(df.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(terms, _TERM_ROWS), True).collect():  # a row an item
            out[r["item"]] = r["s"]
    rest = [i for i, n in enumerate(linear) if n < 2 and i not in serial]
    if not rest:
        return out
    tile = BLOCK
    blocks = blocks_of(df, x, tile)
    wanted = [items[i] for i in rest]
    own = list(dict.fromkeys(k if isinstance(k, SubKernel) else tuple(k.items()) for ks in wanted for k in ks))
    at = [[own.index(k if isinstance(k, SubKernel) else tuple(k.items())) for k in ks] for ks in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ia, xa, _), (ib, xb, _), same = sided(batches, [], blocks)
        total = np.zeros(len(at))
        for a, b in tiles(len(ia), len(ib), tile):
            ks = [(k.matrix(xa[a], xb[b]) if isinstance(k, SubKernel) else matrix(xa[a], xb[b], dict(k))).ravel() for k in own]
            total += [ks[i] @ ks[j] for i, j in at]
        yield pa.RecordBatch.from_pydict({"item": pa.array(rest, pa.int32()), "s": pa.array(total if same else 2 * total)})

    for r in _pairs(df, key, x, [], blocks).groupBy("pair").applyInArrow(run, "item int, s double").groupBy("item").agg(F.sum("s").alias("s")).collect():  # a row an item
        out[r["item"]] = r["s"]
    return out


def products(df: DataFrame, key: str, x: str, parts: list[SubKernel], target: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Frobenius products over all pairs of rows: of the parts with each other, with the kernel ``target``, and of that with itself.

    As many numbers as there are pairs of parts, whatever the rows.
    """
    p = len(parts)
    both = [(i, j) for i in range(p) for j in range(i, p)]
    found = pair_products(df, key, x, [*((parts[i], parts[j]) for i, j in both), *((k, target) for k in parts), (target, target)])
    w = np.zeros((p, p))
    for (i, j), s in zip(both, found):
        w[i, j] = w[j, i] = s
    return w, np.array(found[len(both) : -1]), found[-1]


def widths(df: DataFrame, key: str, x: str, parts: list[SubKernel], target: dict) -> DataFrame:
    """(feature, sigma, alignment): how well each part's kernel aligns with the kernel ``target``. No rows without a row of ``df``."""
    kinds = "feature string, sigma double, alignment double"
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], kinds)
    found = pair_products(df, key, x, [*((k, target) for k in parts), *((k, k) for k in parts), (target, target)])
    own = [math.sqrt(kk * found[-1]) for kk in found[len(parts) : -1]]
    return df.sparkSession.createDataFrame([(k.feature, k.sigma, kt / norm if norm else None) for k, kt, norm in zip(parts, found, own)], kinds)


def best_widths(rated: DataFrame, features: dict[str, list[int]]) -> list[SubKernel]:
    """The width of each feature that aligns best; of equal ones the least."""
    best = rated.groupBy("feature").agg(F.min_by("sigma", F.struct(-F.col("alignment"), F.col("sigma"))).alias("sigma")).collect()  # a row for each feature
    of = {r["feature"]: r["sigma"] for r in best}
    return [SubKernel(name, tuple(at), of[name]) for name, at in features.items() if name in of]


def _surrogate(at: np.ndarray, seen: np.ndarray, places: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at the places of a Gaussian process through what was seen."""
    near = lambda a, b: np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * reach * reach))
    centre, scale = seen.mean(), max(seen.std(), 1e-9)
    solve = np.linalg.solve(near(at, at) + 1e-8 * np.eye(len(at)), np.column_stack([(seen - centre) / scale, near(at, places)]))
    mean = near(places, at) @ solve[:, 0]
    left = 1 - (near(places, at) * solve[:, 1:].T).sum(axis=1)
    return centre + scale * mean, scale * np.sqrt(np.maximum(left, 0))


def _propose(at: list[float], seen: list[float], low: float, high: float, batch: int, least: float) -> list[float]:
    """The places where most is to be gained, one after another as if the surrogate's means had been seen; none if that is less than ``least``."""
    places, at, seen, out = np.linspace(low, high, 201), list(at), list(seen), []
    for _ in range(batch):
        mean, spread = _surrogate(np.array(at), np.array(seen), places, (high - low) / 5)
        z = (mean - max(seen)) / np.maximum(spread, 1e-12)
        below = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        gain = np.where(spread > 1e-9, (mean - max(seen)) * below + spread * np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 0.0)
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        out.append(float(places[best]))
        at.append(out[-1])
        seen.append(float(mean[best]))
    return out


def search_widths(
    df: DataFrame, key: str, x: str, features: dict[str, list[int]], low: float, high: float, target: dict, batch: int = 2, rounds: int = 4, least: float = 1e-5
) -> dict[str, dict[float, float]]:
    """For each feature the widths that were tried, with their alignments.

    A surrogate of the alignment over the width's logarithm proposes ``batch`` widths a feature and round;
    those of all features are rated in one pass over pairs of blocks. A feature from which less than
    ``least`` is to be gained rests. Three widths are tried at first, so 3 + ``batch`` * ``rounds`` at most.
    """
    a, b = math.log(low), math.log(high)
    tried: dict[str, dict[float, float]] = {name: {} for name in features}
    wanted = {name: [a + (b - a) * i / 6 for i in (1, 3, 5)] for name in features}
    df = df.where(F.col(x).isNotNull())
    for _ in range(rounds + 1):
        parts = [SubKernel(name, tuple(features[name]), math.exp(p)) for name, places in wanted.items() for p in places]
        if not parts:
            break
        for r in widths(df, key, x, parts, target).collect():  # a row for each width
            tried[r["feature"]][r["sigma"]] = r["alignment"]
        wanted = {name: _propose([math.log(s) for s in seen], list(seen.values()), a, b, batch, least) for name, seen in tried.items() if seen}
    return tried


def learn(df: DataFrame, key: str, x: str, features: dict[str, list[int]], sigmas: list[float], target: dict) -> list[SubKernel]:
    """A width and a weight for each feature; features whose kernels do not help have the weight 0. Rows without a vector are left out."""
    df = df.where(F.col(x).isNotNull())
    parts = best_widths(widths(df, key, x, grid(features, sigmas), target), features)
    if not parts:
        return []
    w, v, _ = products(df, key, x, parts, target)
    return [SubKernel(p.feature, p.components, p.sigma, float(a)) for p, a in zip(parts, alignment.coefficients(w, v))]


def final_gram(df: DataFrame, key: str, x: str, parts: list[SubKernel], least: float = 1e-9) -> DataFrame:
    """(i, j, k), i <= j: the weighted sum of the parts whose weight exceeds ``least``, added up block by block."""
    used = [p for p in parts if p.weight > least]
    if not used:
        raise ValueError("no weight is positive")
    df = df.where(F.col(x).isNotNull())
    tile = BLOCK
    blocks = blocks_of(df, x, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ia, xa, _), (ib, xb, _), same = sided(batches, [], blocks)
        for a, b in tiles(len(ia), len(ib), tile):
            yield upper(ia[a], ib[b], sum(p.weight * p.matrix(xa[a], xb[b]) for p in used), same)

    return _pairs(df, key, x, [], blocks).groupBy("pair").applyInArrow(run, "i long, j long, k double")


#: The set of all rows, beside those that are numbered from 0.
ALL = -1


def set_sums(df: DataFrame, key: str, x: str, sets: str, n_sets: int, parts: list[SubKernel]) -> DataFrame:
    """(part, a, b, s): each part's kernel added up between sets of rows that may overlap, and between them and all rows.

    ``sets`` is an array of the sets (0 to ``n_sets`` - 1) that a row is in, such
    as the predicates that hold on it. No pair of rows is ever a row.
    """
    df = df.where(F.col(x).isNotNull()).select(key, x, F.array_union(F.coalesce(F.col(sets).cast("array<int>"), F.array().cast("array<int>")), F.array(F.lit(ALL))).alias("g"))
    width = df.agg(F.coalesce(F.max(F.size(x)), F.lit(0))).first()[0]
    serial = {n: s for n, s in enumerate(_serial(df, x, width, [_scales(p, width) for p in parts])) if s is not None}
    rest = [n for n in range(len(parts)) if n not in serial]

    def members(of: list[list[int]]) -> np.ndarray:
        v = np.zeros((len(of), n_sets + 1))
        for i, s in enumerate(of):
            v[i, [j % (n_sets + 1) for j in s]] = 1.0  # all rows: the last column
        return v

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, of = _vectors_of(batch), members(batch.column("g").to_pylist())
            there = np.flatnonzero(of.any(axis=0)).tolist()
            for n, s in serial.items():
                for at, t in s.of(rows):
                    sums = of[at].T @ t
                    for a in there:
                        k = n, a if a < n_sets else ALL
                        found[k] = found[k] + sums[a] if k in found else sums[a]
        yield from _handed(found)

    out = None
    if serial:
        out = _folded(df.select(F.col(x).cast("array<double>").alias("x"), "g").mapInArrow(terms, _TERM_ROWS), False).withColumnRenamed("item", "part")
    if not rest and out is not None:
        return out
    tile = BLOCK
    blocks = blocks_of(df, x, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ia, xa, (ga,)), (ib, xb, (gb,)), same = sided(batches, ["g"], blocks)
        if not len(ia) or not len(ib):
            return
        va, vb = members(ga), members(gb)
        for n in rest:
            s = np.zeros((n_sets + 1, n_sets + 1))
            for a, b in tiles(len(ia), len(ib), tile):
                s += va[a].T @ parts[n].matrix(xa[a], xb[b]) @ vb[b]
            s = s if same else s + s.T
            i, j = np.nonzero(s)
            of = np.array([*range(n_sets), ALL])
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(i), pa.int32()), pa.array(of[i], pa.int32()), pa.array(of[j], pa.int32()), pa.array(s[i, j])], ["part", "a", "b", "s"])

    tiled = _pairs(df, key, x, ["g"], blocks).groupBy("pair").applyInArrow(run, "part int, a int, b int, s double").groupBy("part", "a", "b").agg(F.sum("s").alias("s"))
    return tiled if out is None else out.unionByName(tiled)


def set_kernel(sums: DataFrame, how: str, sizes: DataFrame | None = None) -> DataFrame:
    """(part, a, b, k): a kernel between sets from ``set_sums``.

    ``tanimoto``: s_ab / (m_a + m_b - s_ab), m being a set's sum with all rows;
    ``normalised``: s_ab / sqrt(s_aa s_bb), a scale that is not positive counting
    as 1; ``mean-map``: s_ab / (n_a n_b), with ``sizes`` (a, n).
    """
    pairs = sums.where((F.col("a") != ALL) & (F.col("b") != ALL))
    if how == "tanimoto":
        own = sums.where((F.col("b") == ALL) & (F.col("a") != ALL)).select("part", "a", F.col("s").alias("m"))
    elif how == "normalised":
        own = pairs.where("a = b").select("part", "a", F.when(F.col("s") > 0, F.sqrt("s")).otherwise(F.lit(1.0)).alias("m"))
    elif how == "mean-map" and sizes is not None:
        own = pairs.select("part", "a").distinct().join(sizes.select("a", F.col("n").cast("double").alias("m")), "a").select("part", "a", "m")
    else:
        raise ValueError(f"no kernel between sets: {how}, or no sizes for it")
    both = pairs.join(own.withColumnRenamed("m", "ma"), ["part", "a"]).join(own.select("part", F.col("a").alias("b"), F.col("m").alias("mb")), ["part", "b"])
    value = F.col("s") / (F.col("ma") + F.col("mb") - F.col("s")) if how == "tanimoto" else F.col("s") / (F.col("ma") * F.col("mb"))
    return both.select("part", "a", "b", value.alias("k"))


def set_alignment(k: DataFrame, target: DataFrame) -> DataFrame:
    """(part, alignment) of kernels between sets with another one (a, b, t), such as the Jaccard kernel of predicates."""
    both = k.join(target, ["a", "b"])
    tt = F.broadcast(target.agg(F.sum(F.col("t") * F.col("t")).alias("tt")))  # one row
    sums = both.groupBy("part").agg(F.sum(F.col("k") * F.col("t")).alias("kt"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return sums.join(tt, F.lit(True)).select("part", (F.col("kt") / F.sqrt(F.col("kk") * F.col("tt"))).alias("alignment"))
