"""Kernels between vectors, Gram matrices by blocks, spectra, and mean deviation scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.sources.scratch import cut, file_bytes, new_file, shared_folder

from .prefix import running

#: Rows of a tile of a Gram matrix.
BLOCK = 512
#: Blocks of rows, of one tile at least, that rows are dealt to in pairs; more of them where one would have more numbers than ``HELD``.
GRID, HELD = 24, 1 << 22
#: Groups and directions whose totals may be sent to all tasks.
SENT_GROUPS = 1 << 18


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def squared_distance(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column | str, p: float = 2.0) -> Column:
    """The p-norm of an array; p may be infinite."""
    mags = F.transform(x, lambda v: F.abs(v))
    if p == float("inf"):
        return F.array_max(mags)
    return F.pow(F.aggregate(F.transform(mags, lambda v: F.pow(v, F.lit(float(p)))), F.lit(0.0), lambda s, v: s + v), F.lit(1.0 / p))


def linear() -> dict:
    return {"kind": "linear"}


def rbf(sigma: float = 1.0, kind: str = "gaussian") -> dict:
    """gaussian: exp(-d^2/(2 s^2)); exp: exp(-d/(2 s)); inv-quadratic: d^(-2 s), d being the Euclidean distance."""
    if kind not in ("gaussian", "exp", "inv-quadratic"):
        raise ValueError(f"no such kernel: {kind}")
    return {"kind": kind, "sigma": float(sigma)}


def matrix(x: np.ndarray, y: np.ndarray, kernel: dict) -> np.ndarray:
    out = x @ y.T
    if kernel["kind"] == "linear":
        return out
    out *= -2.0
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)[None, :]
    np.maximum(out, 0.0, out=out)
    s = kernel["sigma"]
    if kernel["kind"] == "gaussian":
        out *= -1.0 / (2 * s * s)
        return np.exp(out, out=out)
    if kernel["kind"] == "exp":
        return np.exp(-np.sqrt(out) / (2 * s))
    with np.errstate(divide="ignore"):
        return out**-s


def diagonal(x: np.ndarray, kernel: dict) -> np.ndarray:
    """The kernel of each row with itself."""
    return (x * x).sum(1) if kernel["kind"] == "linear" else np.full(len(x), matrix(np.zeros((1, 1)), np.zeros((1, 1)), kernel)[0, 0])


def scalar_kernel(d: Column, kind: str, width: float = 1.0, band: float | None = None) -> Column:
    """Shift-invariant kernels of a difference: triangular, indicator, constant, rbf."""
    if kind == "triangular":
        b = width if band is None else band
        return F.greatest(F.lit(0.0), 1 - F.least(F.abs(d), F.lit(b + 1.0)) / (width + 1.0))
    if kind == "indicator":
        return (d == 0).cast("double")
    if kind == "constant":
        return F.lit(1.0)
    if kind == "rbf":
        return F.exp(-d * d / (2 * width * width))
    raise ValueError(f"no such kernel: {kind}")


def blocks_of(df: DataFrame, x: str, tile: int) -> int:
    """How many blocks the rows are dealt to: a number that stays as rows grow, until a block has ``HELD`` numbers."""
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(x)), F.lit(1))).first()
    return max(1, min(-(-n // tile), max(GRID, -(-n * max(width, 1) // HELD))))


def _pairs(df: DataFrame, key: str, x: str, extra: list[str], blocks: int) -> DataFrame:
    """Rows dealt to every pair of blocks that holds theirs: side 0 is the first, side 1 the second block."""
    rows = df.select(F.col(key).alias("id"), F.col(x).cast("array<double>").alias("x"), *extra).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    first = F.transform(F.filter(every, lambda o: o >= F.col("b")), lambda o: F.struct((F.col("b") * blocks + o).alias("pair"), F.lit(0).alias("side")))
    second = F.transform(F.filter(every, lambda o: o <= F.col("b")), lambda o: F.struct((o * blocks + F.col("b")).alias("pair"), F.lit(1).alias("side")))
    dealt = rows.withColumn("_to", F.explode(F.concat(first, second))).select("id", "x", *extra, "_to.pair", "_to.side")
    return dealt.repartition(blocks * (blocks + 1) // 2, "pair")


def _side(t: pa.Table, extra: list[str]) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """(ids, vectors, further columns), by id."""
    t = t.take(pc.sort_indices(t, [("id", "ascending")])).combine_chunks()
    n = t.num_rows
    x = t.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    ids = t.column("id").to_pylist()
    return np.array(ids, np.int64 if pa.types.is_integer(t.schema.field("id").type) else object), np.array(x.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 1)), [t.column(e).to_pylist() for e in extra]


def _sides(table: pa.Table, extra: list[str]) -> list[tuple[np.ndarray, np.ndarray, list[list]]]:
    """(ids, vectors, further columns) of each side, by id."""
    return [_side(table.filter(pc.equal(table.column("side"), side)), extra) for side in (0, 1)]


def sided(batches: Iterator[pa.RecordBatch], extra: list[str], blocks: int) -> tuple[tuple, tuple, bool]:
    """Both sides of a pair of blocks, and whether they are one block."""
    table = pa.Table.from_batches(list(batches))
    first, second = _sides(table, extra)
    return first, second, table.column("pair")[0].as_py() % (blocks + 1) == 0


def block_pairs(df: DataFrame, key: str, x: str, extra: list[str], run: Callable[[tuple, tuple, bool], Iterator[pa.RecordBatch]], schema: str, tile: int) -> DataFrame:
    """What ``run`` makes of every pair of blocks of rows, a task for each: both sides (ids, vectors, further columns), by id, and whether they are one block.

    A block is written once, to a file in the shared folder that the tasks of its pairs read, so disk and shuffle
    grow with the rows and not with their pairs. The driver gets the files' names, one for some 10,000 rows or more.
    """
    spark, blocks = df.sparkSession, blocks_of(df, x, tile)
    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = pa.Table.from_batches(list(batches)), pa.BufferOutputStream()
        with pa.ipc.new_file(out, table.schema) as to:
            to.write_table(table)
        yield pa.RecordBatch.from_pydict({"file": [new_file(folder, ".arrow", out.getvalue())]})

    rows = df.select(F.col(key).alias("id"), F.col(x).alias("x"), *extra).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    files = [r["file"] for r in rows.repartition(blocks, "_b").groupBy("_b").applyInArrow(write, "file string").collect()]

    def side(file: str) -> tuple:
        return _side(pa.ipc.open_file(file_bytes(file)).read_all(), extra)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                first = 0
                while at >= len(files) - first:
                    at, first = at - (len(files) - first), first + 1
                a = side(files[first])
                yield from run(a, side(files[first + at]) if at else a, at == 0)

    pairs = len(files) * (len(files) + 1) // 2
    return spark.range(0, pairs, 1, max(1, min(pairs, 1 << 14))).mapInArrow(each, schema)


def rounded(k: np.ndarray, digits: int | None) -> np.ndarray:
    """To so many decimals, halves away from 0, as SQL does, and no 0 has a sign; None: as they are."""
    if digits is None:
        return k
    k = k * 10.0**digits
    return np.trunc(k + np.copysign(0.5, k)) / 10.0**digits + 0.0


def tiles(n: int, m: int, tile: int) -> Iterator[tuple[slice, slice]]:
    """The tiles of an n by m matrix."""
    for a in range(0, n, tile):
        for b in range(0, m, tile):
            yield slice(a, a + tile), slice(b, b + tile)


def upper(ia: np.ndarray, ib: np.ndarray, k: np.ndarray, same: bool) -> pa.RecordBatch:
    """The entries (i, j, k), i <= j, of a tile: of a block with itself half of them."""
    if same:
        keep = ia[:, None] <= ib[None, :]
        return pa.RecordBatch.from_pydict({"i": np.broadcast_to(ia[:, None], k.shape)[keep], "j": np.broadcast_to(ib[None, :], k.shape)[keep], "k": k[keep]})
    return pa.RecordBatch.from_pydict({"i": np.minimum(ia[:, None], ib[None, :]).ravel(), "j": np.maximum(ia[:, None], ib[None, :]).ravel(), "k": k.ravel()})


def gram(df: DataFrame, key: str, x: str, kernel: dict, normalise: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, k), i <= j: the kernel of all pairs of rows, a pair of blocks to a task, which hands on tile after tile.

    ``normalise``: over the roots of both rows' kernel with themselves, one that is not positive counting as 1.
    ``digits``: rounded to so many decimals.
    """
    tile = BLOCK

    def run(first: tuple, second: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (ia, xa, _), (ib, xb, _) = first, second
        sa, sb = (np.sqrt(np.where((d := diagonal(v, kernel)) > 0, d, 1.0)) if normalise else None for v in (xa, xb))
        for a, b in tiles(len(ia), len(ib), tile):
            if same and ia[a][0] > ib[b][-1]:
                continue
            k = matrix(xa[a], xb[b], kernel)
            yield upper(ia[a], ib[b], rounded(k / (sa[a, None] * sb[None, b]) if normalise else k, digits), same)

    return block_pairs(df, key, x, [], run, "i long, j long, k double", tile)


def group_sums(df: DataFrame, key: str, x: str, group: str, kernel: dict) -> DataFrame:
    """(ga, gb, s): sums of the kernel between groups; no pair of rows is ever a row."""
    tile = BLOCK

    def coded(labels: list) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.array(labels, object).astype(str), return_inverse=True)

    def rows(la: np.ndarray, lb: np.ndarray, s: np.ndarray, same: bool) -> pa.RecordBatch:
        ga, gb = (x.ravel() for x in np.meshgrid(la, lb, indexing="ij"))
        if not same:  # the mirrored pair of blocks
            ga, gb, s = np.concatenate([ga, gb]), np.concatenate([gb, ga]), np.concatenate([s.ravel(), s.ravel()])
        return pa.RecordBatch.from_arrays([pa.array(ga.tolist(), pa.string()), pa.array(gb.tolist(), pa.string()), pa.array(s.ravel(), pa.float64())], ["ga", "gb", "s"])

    def run(first: tuple, second: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (_, xa, (ga,)), (_, xb, (gb,)) = first, second
        if not len(ga) or not len(gb):
            return
        (la, ca), (lb, cb) = coded(ga), coded(gb)
        few = len(la) * len(lb) <= HELD  # added up here; beyond that a tile at a time
        total = np.zeros((len(la), len(lb))) if few else None
        for a, b in tiles(len(ga), len(gb), tile):
            (ua, pa_), (ub, pb) = np.unique(ca[a], return_inverse=True), np.unique(cb[b], return_inverse=True)
            s = np.eye(len(ua))[pa_].T @ (matrix(xa[a], xb[b], kernel) @ np.eye(len(ub))[pb])
            if few:
                total[np.ix_(ua, ub)] += s
            else:
                yield rows(la[ua], lb[ub], s, same)
        if few:
            yield rows(la, lb, total, same)

    return block_pairs(df.withColumn("g", F.col(group).cast("string")), key, x, ["g"], run, "ga string, gb string, s double", tile).groupBy("ga", "gb").agg(F.sum("s").alias("s"))


def mean_deviation(df: DataFrame, key: str, x: str, group: str, kernel: dict, gamma: float = 1.0, anomaly: bool = False) -> DataFrame:
    """(group, n, score): f^(gamma - 2) * z'Kz of each group, z being its mask less its share, f = m(n - m)/n or (anomaly) m."""
    if kernel["kind"] == "linear":
        return _linear_deviation(df, x, group, gamma, anomaly)
    sums = cut(group_sums(df, key, x, group, kernel), "sums")  # read three times
    counts = df.groupBy(F.col(group).cast("string").alias("ga")).agg(F.count(F.lit(1)).alias("m"))
    own = sums.where("ga = gb").select("ga", F.col("s").alias("own"))
    cross = sums.groupBy("ga").agg(F.sum("s").alias("cross"))
    total, n = sums.agg(F.sum("s")).first()[0], df.count()
    share = F.col("m") / F.lit(float(n))
    z = F.col("own") - 2 * share * F.col("cross") + share * share * F.lit(total)
    f = F.col("m").cast("double") if anomaly else F.col("m") * (F.lit(float(n)) - F.col("m")) / F.lit(float(n))
    rows = counts.join(own, "ga").join(cross, "ga")
    return rows.select(F.col("ga").alias(group), F.col("m").alias("n"), F.when(F.col("m") < n, F.pow(f, F.lit(gamma - 2.0)) * z).otherwise(F.lit(0.0)).alias("score"))


def _linear_deviation(df: DataFrame, x: str, group: str, gamma: float, anomaly: bool) -> DataFrame:
    """The linear kernel's score is a distance of means: one aggregate, and no pair of rows."""
    each = df.where(F.col(x).isNotNull()).select(F.col(group).cast("string").alias(group), F.posexplode(F.col(x).cast("array<double>")).alias("d", "v"))
    sums = each.groupBy(group, "d").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy("d").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))  # a row for each dimension
    z = F.col("s") - F.col("n") * F.col("all_s") / F.col("all_n")
    rows = sums.join(F.broadcast(total), "d").groupBy(group).agg(F.max("n").alias("n"), F.max("all_n").alias("all"), F.sum(z * z).alias("z"))
    f = F.col("n").cast("double") if anomaly else F.col("n") * (F.col("all") - F.col("n")) / F.col("all")
    return rows.select(group, "n", F.when(F.col("n") < F.col("all"), F.pow(f, F.lit(gamma - 2.0)) * F.col("z")).otherwise(F.lit(0.0)).alias("score"))


def pair_sums(df: DataFrame, key: str, x: str, kernels: tuple[dict, dict]) -> DataFrame:
    """(ab, aa, bb): sums over all pairs of rows of two kernels' products; a block pair gives one row, no matrix is written."""
    tile = BLOCK

    def run(first: tuple, second: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (ia, xa, _), (ib, xb, _) = first, second
        total = np.zeros(3)
        for a, b in tiles(len(ia), len(ib), tile):
            u, v = (matrix(xa[a], xb[b], k).ravel() for k in kernels)
            total += (u @ v, u @ u, v @ v)
        yield pa.RecordBatch.from_pydict({n: pa.array([float(t)]) for n, t in zip(("ab", "aa", "bb"), total if same else 2 * total)})

    return block_pairs(df, key, x, [], run, "ab double, aa double, bb double", tile).agg(*(F.sum(c).alias(c) for c in ("ab", "aa", "bb")))


def times_vector(k: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, v): the product of a kernel table (i <= j, k) and a vector (i, v)."""
    both = k.unionByName(k.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))
    return both.join(vector.select(F.col("i").alias("j"), "v"), "j").groupBy("i").agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def sub_matrix(k: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of a kernel table between the given ids (i)."""
    return k.join(ids.select("i"), "i", "left_semi").join(ids.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "k")


def weighted_sum(weighted: list[tuple[float, DataFrame]], least: float = 1e-9) -> DataFrame:
    """The sum of kernel tables times their weights; those of weights up to ``least`` are left out."""
    used = [k.select("i", "j", (F.lit(float(w)) * F.col("k")).alias("k")) for w, k in weighted if w > least]
    if not used:
        raise ValueError("no weight is positive")
    return reduce(DataFrame.unionByName, used).groupBy("i", "j").agg(F.sum("k").alias("k"))


def features(df: DataFrame, key: str, x: str, kernel: dict, landmarks: int = 256) -> DataFrame:
    """``df`` with ``features``, arrays whose dot products are the kernel (Nystroem).

    ``landmarks`` rows of least hash span the space: a bounded sample, and exact
    if it holds all rows (or as many independent ones as the kernel's rank).
    """
    picked = df.where(F.col(x).isNotNull()).orderBy(F.xxhash64(key), key).limit(landmarks).select(F.col(x).cast("array<double>").alias("x")).collect()
    base = np.array([r["x"] for r in picked], float)
    values, vectors = np.linalg.eigh(matrix(base, base, kernel)) if len(base) else (np.zeros(0), np.zeros((0, 0)))
    on = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
    map_ = vectors[:, on] / np.sqrt(values[on])
    shared = df.sparkSession.sparkContext.broadcast((base, map_))

    def run(batches):
        for batch in batches:
            rows = batch.column(x).to_pylist()
            known = [i for i, r in enumerate(rows) if r is not None]
            out: list = [None] * len(rows)
            if known and len(shared.value[0]):
                found = matrix(np.array([rows[i] for i in known], float), shared.value[0], kernel) @ shared.value[1]
                for i, f in zip(known, found.tolist()):
                    out[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "features"])

    kept = df.drop("features")
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, features array<double>")


def _moments(batches):
    """(i, j, s): a task's sums of the products of components."""
    total = None
    for batch in batches:
        x = batch.column("x")
        if len(x):
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            total = rows.T @ rows if total is None else total + rows.T @ rows
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])


def moments(df: DataFrame, x: str, size: int) -> np.ndarray:
    """The sums of the products of components, a matrix of the vectors' length."""
    sums = df.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((size, size))
    for r in sums.collect():  # size x size rows
        out[r["i"], r["j"]] = r["s"]
    return out


def mean_deviation_bound(df: DataFrame, x: str, group: str, gamma: float = 1.0, anomaly: bool = False) -> DataFrame:
    """(group, bound): no subset of a group deviates more (``mmd_bound``), by sums over sorted entries.

    The kernel is that of the arrays' dot products. Its eigenvectors follow from
    the arrays' moments, a matrix of their length; the rest is running sums, by ranges
    of entries: for each direction the extreme sums of s entries, for each s the directions' shares.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(x).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("row"))
    n, size = rows.agg(F.count(F.lit(1)).cast("double"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    values, vectors = np.linalg.eigh(moments(rows, "x", size))
    on = np.flatnonzero(values > 1e-9 * max(values.max(initial=0.0), 1e-300))[::-1]
    axes = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, (vectors[:, i] / np.sqrt(values[i])).tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) for i in on]
    each = rows.select("g", "row", F.posexplode(F.array(*axes)).alias("d", "v"))
    centre = F.broadcast(each.groupBy("d").agg((F.sum("v") / F.lit(n)).alias("c")))  # a row a direction
    # running sums by ranges of entries: those of the s least, and of the s greatest, which is all but the others
    run = cut(running(each.where("g is not null"), ["g", "d"], ["v", "row"], {"s": F.lit(1), "low": F.col("v")}).select("g", "d", "s", "low"), "running")
    whole = run.groupBy("g", "d").agg(F.max("s").alias("m"), F.max_by("low", "s").alias("all"))
    others = run.select("g", "d", F.col("s").alias("rest"), F.col("low").alias("rest_low"))
    sized = run.join(F.broadcast(whole) if whole.count() <= SENT_GROUPS else whole, ["g", "d"]).withColumn("rest", F.col("m") - F.col("s"))
    both = sized.join(others, ["g", "d", "rest"], "left").withColumn("high", F.col("all") - F.coalesce("rest_low", F.lit(0.0)))
    length = F.col("s") * (F.lit(n) - F.col("s")) / F.lit(n)
    reach = F.greatest(F.pow(F.col("high") - F.col("s") * F.col("c"), F.lit(2.0)), F.pow(F.col("low") - F.col("s") * F.col("c"), F.lit(2.0)))
    share = both.join(centre, "d").where(F.col("s") < n).select("g", "d", "s", (reach / length).alias("share"))
    before = F.coalesce(F.sum("share").over(Window.partitionBy("g", "s").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.element_at(F.array(*map(F.lit, values[on].tolist())), F.col("d") + 1)
    given = F.greatest(F.lit(0.0), F.least(F.lit(1.0) - F.col("before"), F.col("share")))
    f = F.col("s").cast("double") if anomaly else length
    by_size = share.withColumn("before", before).groupBy("g", "s").agg(F.sum(given * weight).alias("sum"))
    best = by_size.groupBy("g").agg(F.max(F.pow(f, F.lit(gamma - 2.0)) * length * F.col("sum")).alias("bound"))
    return best.select(F.col("g").alias(group), "bound")


# spectra: of matrices small enough for one machine (thousands of rows)


def spectrum(k: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix; signs such that each vector's sum is not negative."""
    values, vectors = np.linalg.eigh(k)
    order = np.argsort(values)[::-1][: rank or len(values)]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors.sum(axis=0) < 0, -1.0, 1.0)


def without(k: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The matrix less its part in the span of the null space's columns."""
    return k - k @ null @ np.linalg.pinv(null.T @ null) @ null.T


def mmd(values: np.ndarray, vectors: np.ndarray, mask: np.ndarray, gamma: float = 1.0, anomaly: bool = False) -> float:
    """The mean deviation score of a 0/1 mask from the kernel's spectrum."""
    n, m = len(mask), int(mask.sum())
    if m == 0 or m == n:
        return 0.0
    z = vectors[mask.astype(bool)].sum(axis=0) - m * vectors.mean(axis=0)
    f = m if anomaly else m * (n - m) / n
    return float(f ** (gamma - 2) * (values * z * z).sum())


def mmd_bound(values: np.ndarray, vectors: np.ndarray, mask: np.ndarray, gamma: float = 1.0, anomaly: bool = False) -> float:
    """No subset of the mask scores higher.

    For each size, every direction's share of a centred 0/1 vector is at most
    that of the size's best choice in that direction alone, and the shares add
    up to one at most: greedily give them to the largest eigenvalues.
    """
    inside = vectors[mask.astype(bool)]
    n, most = len(mask), len(inside)
    if most == 0:
        return 0.0
    sizes = np.arange(1, most + 1)
    centre = vectors.mean(axis=0)
    low, high = np.cumsum(np.sort(inside, axis=0), axis=0), np.cumsum(np.sort(inside, axis=0)[::-1], axis=0)
    reach = np.maximum((high - sizes[:, None] * centre) ** 2, (low - sizes[:, None] * centre) ** 2)
    length = sizes * (n - sizes) / n
    share = np.divide(reach, length[:, None], out=np.zeros_like(reach), where=length[:, None] > 0)
    before = np.cumsum(share, axis=1) - share
    given = np.clip(1.0 - before, 0.0, share)
    f = sizes.astype(float) if anomaly else length
    scores = np.where(length > 0, np.power(f, gamma - 2, where=f > 0, out=np.zeros(most)) * length * (given * np.maximum(values, 0)).sum(axis=1), 0.0)
    return float(scores.max())
