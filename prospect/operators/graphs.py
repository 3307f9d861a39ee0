"""Attributed graphs as tables: vertices (vid, ...), edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.operators import cores
from prospect.sources.scratch import cut


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, "graph")


def _sorted(df: DataFrame) -> DataFrame:
    """A side with a row for each vertex, to be joined by sorting: it grows with the graph, so it is never gathered and sent."""
    return df.hint("merge")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, as (src < dst), without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def is_directed(edges: DataFrame) -> bool:
    """Whether some edge lacks its reverse."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return not e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").isEmpty()


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges with both ends among the vertices (vid)."""
    return edges.join(_sorted(vertices.select(F.col("vid").alias("src"))), "src", "left_semi").join(_sorted(vertices.select(F.col("vid").alias("dst"))), "dst", "left_semi").select(edges.columns)


def feature_density(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, n_vertices, n_edges, density) of the graphs that features (vid, feature) induce."""
    n = features.groupBy("feature").agg(F.count_distinct("vid").alias("n_vertices"))
    a, b = features.select(F.col("vid").alias("src"), "feature"), features.select(F.col("vid").alias("dst"), "feature")
    m = edges.join(a, "src").join(b, ["dst", "feature"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m, "feature", "left").select("feature", "n_vertices", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.coalesce("n_edges", F.lit(0)) / F.col("n_vertices")).alias("density"))


def coreness(edges: DataFrame) -> DataFrame:
    """(vid, core) of the vertices with edges: each takes the h-index of its neighbours' values until nothing changes."""
    return _coreness(_cut(undirected(edges).select(F.lit(0).alias("g"), "src", "dst"))).select("vid", "core")


def _coreness(edges: DataFrame) -> DataFrame:
    """(g, vid, core) of written edges (g, src, dst), each of a graph g once and no loops."""
    kind = dict(edges.dtypes)["src"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        ends = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()
        ids = _cut(ends.withColumn("id", F.monotonically_increasing_id()))
        of = edges
        for end in ("src", "dst"):
            of = of.join(_sorted(ids.select(F.col("vid").alias(end), F.col("id").alias(f"_{end}"))), end)
        found = _coreness(_cut(of.select("g", F.col("_src").alias("src"), F.col("_dst").alias("dst"))))
        return found.withColumnRenamed("vid", "id").join(_sorted(ids), "id").select("g", "vid", "core")
    edges = edges.select("g", F.col("src").cast("long"), F.col("dst").cast("long"))
    most = _degrees(edges).agg(F.max("degree")).first()[0] or 0
    return (cores.cores if most <= cores.ENDS else _joined_coreness)(edges).select("g", F.col("vid").cast(kind), "core")


def _joined_coreness(edges: DataFrame) -> DataFrame:
    """The same by joins, where the neighbours of one vertex are too many for a block."""
    both = _cut(_ends(edges))
    core, left = _cut(both.groupBy("g", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("core"))), None
    while True:
        # values only ever fall: while their sum does, something changes
        sum_ = core.agg(F.sum("core")).first()[0]
        if sum_ == left:
            return core
        left = sum_
        # neighbours by value, so a hub has as many rows as there are values: the h-index is the greatest c with c or more neighbours of at least c
        near = both.join(_sorted(core.withColumnRenamed("vid", "dst")), ["g", "dst"]).groupBy("g", "src", "core").agg(F.count(F.lit(1)).alias("n"))
        down = Window.partitionBy("g", "src").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)
        core = _cut(near.withColumn("n", F.sum("n").over(down)).groupBy("g", F.col("src").alias("vid")).agg(F.max(F.least("core", "n")).alias("core")))


def _ends(edges: DataFrame) -> DataFrame:
    """(g, src, dst) in both directions, of edges that are there once."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("g", F.explode(ways).alias("w")).select("g", "w.src", "w.dst")


def _degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("g", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(vid, degree) of the vertices with edges."""
    return symmetric(undirected(edges)).groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def vertex_columns(vertices: DataFrame, own: DataFrame, vid: str, wanted: set[str]) -> DataFrame:
    """``vertices`` with ``degree`` and ``core``, as wanted, in the graph of written edges between them, each there once; 0 for one without edges."""
    own = own.select(F.lit(0).alias("g"), "src", "dst")
    for name, of in (("degree", _degrees), ("core", _coreness)):
        if name in wanted:
            # read by the search again and again
            found = _cut(of(own).select(F.col("vid").alias(vid), name))
            vertices = vertices.join(_sorted(found), vid, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
    return vertices


def shells_of(cored: DataFrame, group: Column) -> DataFrame:
    """(group, shells): of each group of vertices (core, ...) how many with edges have which coreness, highest first."""
    shells = cored.where("core > 0").groupBy(group.alias("group"), "core").agg(F.count(F.lit(1)).alias("n"))
    return shells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("core", "n")), asc=False).alias("shells"))


def induced_shells(inside: DataFrame) -> DataFrame:
    """The shells of written groups (group, src, dst) of edges, each there once in its group.

    Groups may share vertices; a vertex is another one in each. All groups are one loop.
    """
    return shells_of(_coreness(inside.select(F.col("group").alias("g"), "src", "dst")), F.col("g"))


def group_measures(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row per group of vertices (group, vid), which may overlap: how well it holds together.

    n_vertices; n_edges inside; edge_vertex_ratio; inverse_conductance, 1 less the
    share of the smaller side's edge ends that cross the border; local_modularity,
    the share of all edges inside less what the degrees alone let expect;
    mean_coreness and max_coreness of the graph that the group induces. Edges
    count once in either direction, loops do not. All groups are one job.
    """
    e = _cut(undirected(edges))
    m = members.select("group", "vid").distinct()
    total = F.broadcast(e.agg(F.count(F.lit(1)).cast("double").alias("total")))  # one row
    degree = _degrees(e.withColumn("g", F.lit(0))).drop("g")
    volume = m.join(_sorted(degree), "vid", "left").groupBy("group").agg(F.count(F.lit(1)).alias("n_vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("volume"))
    a, b = m.select("group", F.col("vid").alias("src")), m.select("group", F.col("vid").alias("dst"))
    inside = _cut(e.join(_sorted(a), "src").join(_sorted(b), ["group", "dst"]).select("group", "src", "dst"))
    counts = inside.groupBy("group").agg(F.count(F.lit(1)).alias("n_edges"))
    # a vertex is another one in every group
    core = _coreness(inside.select(F.col("group").alias("g"), "src", "dst"))
    top = core.groupBy(F.col("g").alias("group")).agg(F.sum("core").alias("cores"), F.max("core").alias("max_core"))
    rows = volume.join(counts, "group", "left").join(top, "group", "left").fillna(0, ["n_edges", "cores", "max_core"]).join(total, F.lit(True))
    side = F.least(F.col("volume"), 2 * F.col("total") - F.col("volume"))
    share = F.col("volume") / (2 * F.col("total"))
    return rows.select(
        "group", "n_vertices", "n_edges", (F.col("n_edges") / F.col("n_vertices")).alias("edge_vertex_ratio"),
        F.when(side > 0, 1 - (F.col("volume") - 2 * F.col("n_edges")) / side).otherwise(F.lit(0.0)).alias("inverse_conductance"),
        F.when(F.col("total") > 0, F.col("n_edges") / F.col("total") - share * share).otherwise(F.lit(0.0)).alias("local_modularity"),
        (F.col("cores") / F.col("n_vertices")).alias("mean_coreness"), F.col("max_core").alias("max_coreness"),
    )


def _digest(label: Column) -> Column:
    """60 bits of a label's MD5 as a number, which add up in any order."""
    return F.conv(F.substring(F.md5(label), 1, 15), 16, 10).cast("decimal(38,0)")


def wl_labels(edges: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """(vid, round, label): Weisfeiler-Lehman labels; each round hashes a vertex's label with the sum of its neighbours' hashes.

    The sum stands for the multiset and is taken before the shuffle, so a hub's neighbours never meet in one row.
    """
    both = _cut(symmetric(edges))  # read in every round
    now = _cut(labels.select("vid", F.col("label").cast("string").alias("label")))
    out = now.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        near = both.join(_sorted(now.select(F.col("vid").alias("dst"), F.col("label").alias("l"))), "dst").groupBy("src").agg(F.sum(_digest(F.col("l"))).alias("near"))
        near = F.coalesce(F.col("near"), F.lit(0).cast("decimal(38,0)")).cast("string"), near
        now = _cut(now.join(_sorted(near[1]), now["vid"] == near[1]["src"], "left").select("vid", F.md5(F.concat_ws(":", "label", near[0])).alias("label")))
        out = out.unionByName(now.withColumn("round", F.lit(r)))
    return out.select("vid", "round", "label")


def label_distance(labels: DataFrame, graph: str) -> DataFrame:
    """(a, b, distance): between graphs, the share of label mass to move, averaged over rounds.

    ``labels`` has (``graph``, vid, round, label). With a cost of 1 between
    different labels the transport distance of two label histograms is half their
    L1 distance, so no transport problem is left: sums over labels suffice.
    """
    size = labels.groupBy(graph, "round").agg(F.count(F.lit(1)).alias("n"))
    mass = labels.groupBy(graph, "round", "label").agg(F.count(F.lit(1)).alias("c")).join(size, [graph, "round"]).select(F.col(graph).alias("a"), "round", "label", (F.col("c") / F.col("n")).alias("x"))
    other = mass.select(F.col("a").alias("b"), "round", "label", F.col("x").alias("y"))
    both = mass.join(other, ["round", "label"]).where("a < b").groupBy("a", "b", "round").agg(F.sum(F.least("x", "y")).alias("kept"))
    ids = size.select(F.col(graph).alias("a"), "round")
    # graphs that share no label are at distance 1; graphs are few, their vertices are not
    every = ids.join(ids.select(F.col("a").alias("b"), "round"), "round").where("a < b")
    return every.join(both, ["a", "b", "round"], "left").groupBy("a", "b").agg(F.avg(1 - F.coalesce("kept", F.lit(0.0))).alias("distance"))


def wl_kernel(vertices: DataFrame, edges: DataFrame, graph: str, rounds: int = 3, gamma: float = 1.0) -> DataFrame:
    """(a, b, k) of graphs with a <= b: exp(-gamma D), D the Wasserstein distance of their vertices' Weisfeiler-Lehman labels.

    ``vertices`` has (vid, ``graph``, label); edges (src, dst) between graphs do not count. A vertex
    is the tuple of its labels over the rounds, two are as far apart as the share of rounds in which they differ.
    As labels are only ever refined, that is a distance in a tree, for which the cost of the
    best transport is the mass that has to leave each label, averaged over the rounds: ``label_distance``.
    """
    of = vertices.select("vid", graph)
    a, b = of.select(F.col("vid").alias("src"), F.col(graph).alias("_a")), of.select(F.col("vid").alias("dst"), F.col(graph).alias("_b"))
    inside = edges.join(_sorted(a), "src").join(_sorted(b), "dst").where("_a = _b").select("src", "dst")
    labels = _cut(wl_labels(inside, vertices.select("vid", "label"), rounds).join(_sorted(of), "vid"))
    found = label_distance(labels, graph).select("a", "b", F.exp(-F.lit(float(gamma)) * F.col("distance")).alias("k"))
    own = vertices.select(F.col(graph).alias("a")).distinct()
    return found.unionByName(own.select("a", F.col("a").alias("b"), F.lit(1.0).alias("k")))


def communities(edges: DataFrame, features: DataFrame, k: int = 1, take_back: bool = False) -> list[dict]:
    """Greedy densest patterns: grow a conjunction of features to the end, keep its densest prefix, cover its edges, repeat.

    A community's vertices have all its features. Features that a prefix does not
    need for its vertices are left out. ``take_back``: edges that a smaller
    community covered count again for later, larger ones.
    """
    whole = left = _cut(undirected(edges))
    out: list[dict] = []
    for _ in range(k):
        members, chosen, best = features.select("vid").distinct(), [], None
        while True:
            rest = features.join(members, "vid", "left_semi")
            if chosen:
                rest = rest.where(~F.col("feature").isin(chosen))
            top = feature_density(left, rest).orderBy(F.desc("density"), "feature").first()
            if top is None or top["n_edges"] == 0:
                break
            chosen.append(top["feature"])
            members = _cut(members.join(features.where(F.col("feature") == top["feature"]).select("vid"), "vid", "left_semi"))
            if best is None or top["density"] > best[1]:
                best = (list(chosen), top["density"], members)
        if best is None:
            break
        chosen, density, members = best
        n = members.count()
        for f in list(chosen):  # without a redundant feature the vertices are the same
            others = [g for g in chosen if g != f]
            if others and features.where(F.col("feature").isin(others)).select("vid", "feature").distinct().groupBy("vid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == len(others)).count() == n:
                chosen = others
        inside = _cut(induced(left, members))
        out.append({"features": sorted(chosen), "density": density, "n_vertices": n, "n_edges": inside.count(), "_edges": inside})
        left = whole
        for c in out:
            if not take_back or c["n_vertices"] >= n:
                left = left.join(c["_edges"].select("src", "dst"), ["src", "dst"], "left_anti")
        left = _cut(left)
    return [{key: v for key, v in c.items() if key != "_edges"} for c in out]
