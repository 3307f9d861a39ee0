"""The registered queries, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospect.functions.discretise import Entropy, Fixed, Frequency, Interval, Ranges, Uniform, bin_counts, entropy
from prospect.functions.predicates import Attribute, Equals, Kind, Negate, Predicate, Prediciser, Ranged
from prospect.operators import alignment, closed, graphs, ingest, kernels, language, learning, scores, search, spectra
from prospect.sources import database
from prospect.sources.scratch import cut, shared_folder
from prospect.sources.tables import customer_supplier_edges, embeddings_view, lineitem_view, orders_view, read, trade_edges, trade_vertices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


# the orders view: predicates 0-2 status, 3-7 priority, 8-10 months from a number on

_STATUS, _PRIORITY, _MONTHS = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), (4, 7, 10)
ORDER_PREDICATES: list[Predicate] = [
    *(Equals(Attribute("o_orderstatus", Kind.CATEGORICAL, position=1), category=v) for v in _STATUS),
    *(Equals(Attribute("o_orderpriority", Kind.CATEGORICAL, position=2), category=v) for v in _PRIORITY),
    *(Ranged(Attribute("month", Kind.NUMERICAL, position=3), interval=Interval(float(m), None, name=f"from {m}")) for m in _MONTHS),
]
_TESTS = [*(f"st = '{v}'" for v in _STATUS), *(f"pr = '{v}'" for v in _PRIORITY), *(f"mo >= {m}" for m in _MONTHS)]
_O = """o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, c_mktsegment AS sg, r_name AS rn, month(o_orderdate) AS mo, c_acctbal AS ab, o_totalprice AS y, o_totalprice >= 250000 AS t
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_P = _O + ", p AS (" + " UNION ALL ".join(f"SELECT k, y, t, {i} AS pid FROM o WHERE {c}" for i, c in enumerate(_TESTS)) + "), tot AS (SELECT count(*) AS n, avg(y) AS mu, count(*) FILTER (t) AS nt FROM o)"
#: Conjunctions of up to three predicates with their rows.
_C1 = "SELECT [pid] AS c, k, y, t FROM p"
_C2 = "SELECT [a.pid, b.pid] AS c, a.k, a.y, a.t FROM p a JOIN p b ON a.k = b.k AND a.pid < b.pid"
_C3 = "SELECT [a.pid, b.pid, d.pid] AS c, a.k, a.y, a.t FROM p a JOIN p b ON a.k = b.k AND a.pid < b.pid JOIN p d ON a.k = d.k AND b.pid < d.pid"
_C0 = "SELECT CAST([] AS INTEGER[]) AS c, k, y, t FROM o"


def _scored(levels: list[str], value: str) -> str:
    return f"WITH {_P}, c AS ({' UNION ALL '.join(levels)}), s AS (SELECT c, count(*) AS m, sum(y) AS sy, sum(greatest(y - mu, 0)) AS gain, count(*) FILTER (t) AS hit, any_value(n) AS n, any_value(mu) AS mu, any_value(nt) AS nt FROM c, tot GROUP BY c) SELECT array_to_string(c, ',') AS indices, m AS n, round({value}, 6) AS score FROM s"


def _top(levels: list[str], value: str, k: int) -> str:
    return f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, depth, c) AS rank FROM (SELECT *, string_split(indices, ',') AS parts, CASE WHEN indices = '' THEN 0 ELSE len(string_split(indices, ',')) END AS depth, CASE WHEN indices = '' THEN CAST([] AS INTEGER[]) ELSE CAST(string_split(indices, ',') AS INTEGER[]) END AS c FROM ({_scored(levels, value)}))) SELECT CAST(rank AS INTEGER) AS rank, indices, n, score FROM r WHERE rank <= {k}"


def _shift(a: float, b: float) -> str:
    return f"pow(m / n, {a}) * pow(greatest(sy / m - mu, 0), {b})"


def _every(spark: SparkSession, sf_dir: str, measure: scores.Score, depths: tuple[int, ...]) -> DataFrame:
    """Scores of all conjunctions of the depths that have rows."""
    from itertools import combinations

    df = orders_view(spark, sf_dir)
    totals = scores.Totals.of(df, measure.target)
    parts = measure.parts(totals)
    table = language.compress(df, ORDER_PREDICATES, parts)
    sets = [c for d in depths for c in combinations(range(len(ORDER_PREDICATES)), d)]
    rated = language.score(table, sets, len(ORDER_PREDICATES), {k: how for k, (_, how) in parts.items()})
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(sets)], "cid long, indices string")
    return rated.join(F.broadcast(names), "cid").select("indices", "n", F.round(measure.value(totals), 6).alias("score"))


def _best(spark: SparkSession, sf_dir: str, measure: scores.Score, bound: scores.Score, k: int, depth: int, **how) -> DataFrame:
    found = search.search(orders_view(spark, sf_dir), ORDER_PREDICATES, measure, bound, k, depth, **how)
    return spark.createDataFrame([(i + 1, ",".join(map(str, f.indices)), f.n, round(f.score, 6)) for i, f in enumerate(found.best)], "rank int, indices string, n long, score double")


@query(_scored([_C1], "m / n"))
def predicate_coverage(spark, sf_dir):
    return _every(spark, sf_dir, scores.Coverage(), (1,))


@query(_scored([_C1], "hit / (m + nt - hit)"))
def jaccard_depth1(spark, sf_dir):
    return _every(spark, sf_dir, scores.Jaccard("pricey"), (1,))


@query(_scored([_C2], "hit / (m + nt - hit)"))
def jaccard_depth2(spark, sf_dir):
    return _every(spark, sf_dir, scores.Jaccard("pricey"), (2,))


@query(_scored([_C1, _C2], "hit / nt"))
def jaccard_bound(spark, sf_dir):
    return _every(spark, sf_dir, scores.JaccardBound("pricey"), (1, 2))


@query(_scored([_C1], _shift(1.0, 1.0)))
def mean_shift_depth1(spark, sf_dir):
    return _every(spark, sf_dir, scores.MeanShift("o_totalprice"), (1,))


@query(_scored([_C1, _C2], _shift(0.5, 1.0)))
def coverage_exponent_half(spark, sf_dir):
    return _every(spark, sf_dir, scores.MeanShift("o_totalprice", 0.5), (1, 2))


@query(_scored([_C1, _C2], _shift(1.0, 0.5)))
def coverage_exponent_two(spark, sf_dir):
    return _every(spark, sf_dir, scores.MeanShift("o_totalprice", 2.0), (1, 2))


@query(_scored([_C1, _C2], "gain / n"))
def mean_shift_bound_closed(spark, sf_dir):
    return _every(spark, sf_dir, scores.MeanShiftBound("o_totalprice"), (1, 2))


@query(_scored([_C1, _C2], "pow((m / n) * pow(hit / (m + nt - hit), 2), 1.0 / 3)"))
def geometric_mean_score(spark, sf_dir):
    return _every(spark, sf_dir, scores.Geometric("pricey", (scores.Coverage(), scores.Jaccard("pricey")), (1.0, 2.0)), (1, 2))


@query(_top([_C0, _C1, _C2], _shift(1.0, 1.0), 5))
def mean_shift_depth2_topk(spark, sf_dir):
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice"), scores.MeanShiftBound("o_totalprice"), 5, 2)


@query(_top([_C0, _C1, _C2, _C3], _shift(1.0, 1.0), 5))
def topk_search_depth3(spark, sf_dir):
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice"), scores.MeanShiftBound("o_totalprice"), 5, 3)


@query(_top([_C0, _C1, _C2, _C3], _shift(0.5, 1.0), 5))
def topk_exponent_half(spark, sf_dir):
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice", 0.5), scores.MeanShiftBound("o_totalprice", 0.5), 5, 3)


@query(_top([_C0, _C1, _C2, _C3], _shift(1.0, 0.5), 5))
def topk_exponent_two_grouped(spark, sf_dir):
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice", 2.0), scores.GroupedMeanShiftBound("o_totalprice", 2.0), 5, 3)


@query(_top([_C0, _C1, _C2, _C3], "hit / (m + nt - hit)", 5))
def topk_jaccard_depth3(spark, sf_dir):
    return _best(spark, sf_dir, scores.Jaccard("pricey"), scores.JaccardBound("pricey"), 5, 3)


@query(
    f"SELECT r.rank, r.indices, r.n, r.score, c.score AS coverage, j.score AS jaccard FROM ({_top([_C0, _C1, _C2], _shift(1.0, 1.0), 5)}) r "
    f"JOIN ({_scored([_C0, _C1, _C2], 'm / n')}) c USING (indices) JOIN ({_scored([_C0, _C1, _C2], 'hit / (m + nt - hit)')}) j USING (indices)"
)
def extra_scores(spark, sf_dir):
    df = orders_view(spark, sf_dir)
    found = search.search(df, ORDER_PREDICATES, scores.MeanShift("o_totalprice"), scores.MeanShiftBound("o_totalprice"), 5, 2)
    names = spark.createDataFrame([(i + 1, ",".join(map(str, f.indices))) for i, f in enumerate(found.best)], "rank int, indices string")
    rated = search.with_scores(found, df, ORDER_PREDICATES, {"coverage": scores.Coverage(), "jaccard": scores.Jaccard("pricey")})
    return rated.join(F.broadcast(names), "rank").select("rank", "indices", "n", "score", "coverage", "jaccard")


def _levels(factor: float) -> str:
    """What a search for the five best rates: of three predicates only what has both of its prefixes left open by bound and k-th score."""
    best = "(SELECT min(score) FROM (SELECT score FROM {0} ORDER BY score DESC LIMIT 5))"
    return (
        f"WITH {_P}, c AS ({' UNION ALL '.join([_C0, _C1, _C2, _C3])}), g AS (SELECT c, count(*) AS m, sum(y) AS sy, sum(greatest(y - mu, 0)) AS gain, any_value(n) AS n, any_value(mu) AS mu FROM c, tot GROUP BY c), "
        f"s AS (SELECT c, len(c) AS depth, m, {_shift(1.0, 1.0)} AS score, gain / n AS bound FROM g), r1 AS (SELECT * FROM s WHERE depth <= 1), o1 AS (SELECT * FROM r1 WHERE depth = 1 AND bound * {factor} > {best.format('r1')}), "
        f"r2 AS (SELECT * FROM r1 UNION ALL SELECT * FROM s WHERE depth = 2 AND [c[1]] IN (SELECT c FROM o1) AND [c[2]] IN (SELECT c FROM o1)), o2 AS (SELECT * FROM r2 WHERE depth = 2 AND bound * {factor} > {best.format('r2')}), "
        "r3 AS (SELECT * FROM r2 UNION ALL SELECT * FROM s WHERE depth = 3 AND [c[1], c[2]] IN (SELECT c FROM o2) AND [c[1], c[3]] IN (SELECT c FROM o2))"
    )


_NAMED = "'{' || array_to_string([[" + ", ".join("'" + str(p).replace("'", "''") + "'" for p in ORDER_PREDICATES) + "][i + 1] FOR i IN {0}], '^') || '}'"
_BETTER = "(a.key, a.depth, a.c) < (b.key, b.depth, b.c)"


@query(
    _levels(1.0)
    + ", q AS (SELECT c, depth, round(score, 6) AS score, -round(score, 6) AS key, row_number() OVER (ORDER BY depth, -round(score, 6), c) AS pos FROM r3), "
    + "made AS (SELECT 0 AS depth, 0 AS n UNION ALL SELECT 1, (SELECT 11) UNION ALL SELECT 2, (SELECT count(*) * (count(*) - 1) // 2 FROM o1) UNION ALL SELECT 3, (SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM (SELECT count(*) AS k FROM o2 GROUP BY c[1]))), "
    + f"e AS (SELECT b.*, count(a.c) FILTER ({_BETTER}) AS before, list(a.c ORDER BY a.key, a.depth, a.c) AS had FROM q b LEFT JOIN q a ON a.pos < b.pos GROUP BY ALL) "
    + f"SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS step, CAST(depth AS INTEGER) AS level, (SELECT CAST(sum(n) AS BIGINT) FROM made WHERE made.depth <= e.depth) AS created, {_NAMED.replace('{0}', 'c')} AS pattern, score, CASE WHEN pos > 5 THEN {_NAMED.replace('{0}', 'had[5]')} END AS replaced FROM e WHERE before < 5"
)
def search_history(spark, sf_dir):
    df = orders_view(spark, sf_dir)
    return search.history_frame(search.search(df, ORDER_PREDICATES, scores.MeanShift("o_totalprice"), scores.MeanShiftBound("o_totalprice"), 5, 3), df)


@query(_levels(0.5) + " SELECT CAST(row_number() OVER (ORDER BY round(score, 6) DESC, depth, c) AS INTEGER) AS rank, array_to_string(c, ',') AS indices, m AS n, round(score, 6) AS score FROM r3 QUALIFY rank <= 5")
def approx_search(spark, sf_dir):
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice"), scores.MeanShiftBound("o_totalprice"), 5, 3, factor=0.5)


def _sorted_sql(value: str) -> str:
    return f"WITH {_P}, c AS ({_C1}), r AS (SELECT c[1] AS pid, sum(y) OVER w AS s, row_number() OVER w AS m FROM c WINDOW w AS (PARTITION BY c ORDER BY y DESC, k ROWS UNBOUNDED PRECEDING)) SELECT pid, round(max({value}), 6) AS bound FROM r, tot GROUP BY pid"


def _sorted_bound(spark, sf_dir, exponent: float) -> DataFrame:
    df = orders_view(spark, sf_dir)
    totals = scores.Totals.of(df, "o_totalprice")
    held = F.filter(F.array(*(F.when(p.column(), F.lit(i)) for i, p in enumerate(ORDER_PREDICATES))), lambda x: x.isNotNull())
    members = df.select("o_totalprice", F.explode(held).alias("pid"))
    return scores.sorted_bound(members, "pid", "o_totalprice", totals, exponent).select("pid", F.round("bound", 6).alias("bound"))


@query(_sorted_sql("sqrt(m / n) * greatest(s / m - mu, 0)"))
def mean_shift_bound_sorted(spark, sf_dir):
    return _sorted_bound(spark, sf_dir, 0.5)


@query(_sorted_sql("(m / n) * sqrt(greatest(s / m - mu, 0))"))
def mean_shift_bound_sorted_two(spark, sf_dir):
    return _sorted_bound(spark, sf_dir, 2.0)


@query(_top([_C0, _C1, _C2, _C3], _shift(1.0, 0.5), 5))
def topk_exponent_two_binned(spark, sf_dir):
    bound = scores.BinnedMeanShiftBound.of(orders_view(spark, sf_dir), "o_totalprice", 2.0)
    return _best(spark, sf_dir, scores.MeanShift("o_totalprice", 2.0), bound, 5, 3)


_SIGNATURE = ", ".join(f"({c}) AS b{i}" for i, c in enumerate(_TESTS))


@query(
    f"WITH {_O}, tot AS (SELECT count(*) AS n, avg(y) AS mu FROM o), g AS (SELECT {', '.join(f'b{i}' for i in range(len(_TESTS)))}, sum(y - mu) AS shift FROM (SELECT y, {_SIGNATURE} FROM o), tot GROUP BY ALL), m AS ("
    + " UNION ALL ".join(f"SELECT {i} AS pid, shift FROM g WHERE b{i}" for i in range(len(_TESTS)))
    + ") SELECT pid, round(sum(greatest(shift, 0)) / any_value(n), 6) AS bound FROM m, tot GROUP BY pid"
)
def grouped_bound(spark, sf_dir):
    df = orders_view(spark, sf_dir)
    totals = scores.Totals.of(df, "o_totalprice")
    table = language.compress(df, ORDER_PREDICATES, scores.MeanShift("o_totalprice").parts(totals))
    on = F.filter(F.array(*(F.when(F.get("words", F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(i)) for i in range(len(ORDER_PREDICATES)))), lambda x: x.isNotNull())
    return scores.grouped_bound(table.select("shift", F.explode(on).alias("pid")), "pid", totals).select("pid", F.round("bound", 6).alias("bound"))


@query(
    f"WITH {_P}, pairs AS (SELECT a.pid AS a, b.pid AS b, count(*) AS c FROM p a JOIN p b ON a.k = b.k GROUP BY ALL), own AS (SELECT a, c AS n FROM pairs WHERE a = b) SELECT x.a, y.a AS b, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 6) AS k FROM own x CROSS JOIN own y LEFT JOIN pairs ON pairs.a = x.a AND pairs.b = y.a"
)
def predicate_jaccard_kernel(spark, sf_dir):
    table = language.compress(orders_view(spark, sf_dir), ORDER_PREDICATES, {})
    on = F.filter(F.array(*(F.when(F.get("words", F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(i)) for i in range(len(ORDER_PREDICATES)))), lambda x: x.isNotNull())
    return alignment.jaccard(table.select("n", on.alias("on"))).select("a", "b", F.round("k", 6).alias("k"))


# predicates made from columns


@query("SELECT l_returnflag AS category, count(*) AS n, (SELECT count(*) FROM lineitem) - count(*) AS n_negated FROM lineitem GROUP BY l_returnflag")
def negated_predicates(spark, sf_dir):
    df = lineitem_view(spark, sf_dir)
    found = Prediciser(Frequency(3), Negate.CATEGORICAL).predicates(df, [Attribute("l_returnflag", Kind.CATEGORICAL)])
    row = df.agg(*(F.count_if(p.column()).alias(str(i)) for i, p in enumerate(found))).first()
    count = {(p.category, p.negated): row[str(i)] for i, p in enumerate(found)}
    return spark.createDataFrame([(c, n, count[(c, True)]) for (c, negated), n in count.items() if not negated], "category string, n long, n_negated long")


def _ranges(spark, sf_dir, ranges: Ranges) -> DataFrame:
    made = Fixed(3, ranges, given=(("c_acctbal", (0.0, 3000.0, 6000.0)),))
    found = Prediciser(made, Negate.NONE).predicates(df := orders_view(spark, sf_dir), [Attribute("c_acctbal", Kind.NUMERICAL)])
    row = df.agg(*(F.count_if(p.column()).alias(str(i)) for i, p in enumerate(found))).first()
    return spark.createDataFrame([(i, row[str(i)]) for i in range(len(found))], "pid int, n long")


@query(f"WITH {_O} SELECT 0 AS pid, count(*) FILTER (ab >= 0) AS n FROM o UNION ALL SELECT 1, count(*) FILTER (ab >= 3000) FROM o UNION ALL SELECT 2, count(*) FILTER (ab >= 6000) FROM o")
def range_predicates_slabs(spark, sf_dir):
    return _ranges(spark, sf_dir, Ranges.SLABS_POSITIVE)


@query(f"WITH {_O} SELECT 0 AS pid, count(*) FILTER (ab < 0) AS n FROM o UNION ALL SELECT 1, count(*) FILTER (ab >= 0 AND ab < 3000) FROM o UNION ALL SELECT 2, count(*) FILTER (ab >= 3000 AND ab < 6000) FROM o UNION ALL SELECT 3, count(*) FILTER (ab >= 6000) FROM o")
def range_predicates_intervals(spark, sf_dir):
    return _ranges(spark, sf_dir, Ranges.INTERVALS)


@query("SELECT CAST(i AS INTEGER) AS i, cut FROM (SELECT unnest(quantile_disc(c_acctbal, [0.25, 0.5, 0.75])) AS cut, unnest([0, 1, 2]) AS i FROM customer)")
def frequency_cuts(spark, sf_dir):
    cuts = Frequency(3).cuts(read(spark, sf_dir, "customer"), ["c_acctbal"])["c_acctbal"]
    return spark.createDataFrame(list(enumerate(cuts)), "i int, cut double")


_TIED = ("l_quantity", "l_discount", "l_tax")


@query(
    "WITH "
    + ", ".join(f"v{i} AS (SELECT sum(count(*)) OVER (ORDER BY {c}) - count(*) AS b FROM lineitem GROUP BY {c}), e{i} AS (SELECT '{c}' AS column_name, max(-list_sum([p * ln(p) FOR p IN [x.b / n, (y.b - x.b) / n, (z.b - y.b) / n, 1 - z.b / n]])) AS entropy FROM v{i} x JOIN v{i} y ON 0 < x.b AND x.b < y.b JOIN v{i} z ON y.b < z.b, (SELECT count(*) AS n FROM lineitem))" for i, c in enumerate(_TIED))
    + " SELECT column_name, CAST(3 AS INTEGER) AS n_cuts, round(entropy, 6) AS entropy FROM ("
    + " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(_TIED)))
    + ")"
)
def entropy_cuts(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    cuts = Entropy(3).cuts(df, list(_TIED))
    rows = [(c, len(cuts[c]), round(entropy([r["n"] for r in bin_counts(df, c, cuts[c]).collect()]), 6)) for c in _TIED]  # a row for each bin
    return spark.createDataFrame(rows, "column_name string, n_cuts int, entropy double")


@query("SELECT CAST(i AS INTEGER) AS i, round(lo + (hi - lo) * (i + 1) / 4, 6) AS cut FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), range(3) AS r(i)")
def uniform_cuts(spark, sf_dir):
    cuts = Uniform(3).cuts(read(spark, sf_dir, "customer"), ["c_acctbal"])["c_acctbal"]
    return spark.createDataFrame([(i, round(c, 6)) for i, c in enumerate(cuts)], "i int, cut double")


@query("WITH b AS (SELECT (c_acctbal >= 0)::INT + (c_acctbal >= 3000)::INT + (c_acctbal >= 6000)::INT AS bin, count(*) AS n FROM customer GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM b, (SELECT count(*) AS t FROM customer)")
def bin_entropy(spark, sf_dir):
    rows = bin_counts(read(spark, sf_dir, "customer"), "c_acctbal", [0.0, 3000.0, 6000.0]).collect()  # a row for each bin
    return spark.createDataFrame([(round(entropy([r["n"] for r in rows]), 6),)], "entropy double")


@query("SELECT c_custkey, " + ", ".join(f"c_mktsegment = '{v}' AS {v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def onehot_attributes(spark, sf_dir):
    return ingest.one_hot(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


# closed sets of line items: predicates 0-2 return flag, 3-4 line status, 5-7 quantity from a number on

ITEM_PREDICATES: list[Predicate] = [
    *(Equals(Attribute("l_returnflag", Kind.CATEGORICAL, position=0), category=v) for v in ("A", "N", "R")),
    *(Equals(Attribute("l_linestatus", Kind.CATEGORICAL, position=1), category=v) for v in ("F", "O")),
    *(Ranged(Attribute("l_quantity", Kind.NUMERICAL, position=2), interval=Interval(q, None, name=f"from {q:g}")) for q in (10.0, 25.0, 40.0)),
]
_ITEM_TESTS = [*(f"l_returnflag = '{v}'" for v in "ANR"), *(f"l_linestatus = '{v}'" for v in "FO"), *(f"l_quantity >= {q}" for q in (10, 25, 40))]
_ITEMS = "i AS (SELECT " + ", ".join(f"({c}) AS b{j}" for j, c in enumerate(_ITEM_TESTS)) + " FROM lineitem)"


@query(
    f"WITH {_ITEMS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT {a} AS pid, count(*) AS n, concat_ws(',', " + ", ".join(f"CASE WHEN bool_and(b{b}) THEN '{b}' END" for b in range(len(_ITEM_TESTS))) + f") AS closure FROM i WHERE b{a}" for a in range(len(_ITEM_TESTS))) + ")"
)
def closure_of_predicate(spark, sf_dir):
    table = language.compress(lineitem_view(spark, sf_dir), ITEM_PREDICATES, {})
    found = language.closures(table, [(i,) for i in range(len(ITEM_PREDICATES))], len(ITEM_PREDICATES))
    return spark.createDataFrame([(i, n, ",".join(map(str, c))) for i, (n, c) in enumerate(found)], "pid int, n long, closure string")


@query(f"WITH {_ITEMS} SELECT a, b FROM (" + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b FROM i HAVING count(*) FILTER (b{a}) > 0 AND count(*) FILTER (b{a} AND b{b}) = count(*) FILTER (b{a})" for a in range(len(_ITEM_TESTS)) for b in range(len(_ITEM_TESTS)) if a != b) + ")")
def predicate_subset_pairs(spark, sf_dir):
    return language.supersets(language.compress(lineitem_view(spark, sf_dir), ITEM_PREDICATES, {}), len(ITEM_PREDICATES))


@query(
    f"WITH {_ITEMS}, c AS (SELECT [x FOR x IN ["
    + ", ".join(f"CASE WHEN m // {1 << j} % 2 = 1 THEN {j} END" for j in range(len(_ITEM_TESTS)))
    + f"] IF x IS NOT NULL] AS c, m FROM range({1 << len(_ITEM_TESTS)}) AS r(m)), g AS (SELECT "
    + " + ".join(f"b{j}::INT * {1 << j}" for j in range(len(_ITEM_TESTS)))
    + " AS w, count(*) AS n FROM i GROUP BY 1), s AS (SELECT c.m, sum(n) AS n, bit_and(w::BIGINT) AS closure FROM c JOIN g ON (w::BIGINT & m) = m GROUP BY c.m) SELECT DISTINCT concat_ws(',', "
    + ", ".join(f"CASE WHEN closure // {1 << j} % 2 = 1 THEN '{j}' END" for j in range(len(_ITEM_TESTS)))
    + ") AS closed, CAST(n AS BIGINT) AS n FROM s"
)
def closed_search(spark, sf_dir):
    found = search.search(lineitem_view(spark, sf_dir), ITEM_PREDICATES, scores.Coverage(), scores.Constant(), 1 << len(ITEM_PREDICATES), len(ITEM_PREDICATES), closed=True)
    return spark.createDataFrame([(",".join(map(str, f.indices)), f.n) for f in found.best], "closed string, n long")


@query(SQL["closed_search"])
def closed_restricted(spark, sf_dir):
    table = language.compress(lineitem_view(spark, sf_dir), ITEM_PREDICATES, {})
    return closed.restricted(table, len(ITEM_PREDICATES)).select(F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("closed"), "n")


_N_ITEMS = len(_ITEM_TESTS)
#: The greedy choice, one step for each predicate at most: of those left in the closure the one that leaves the fewest rows.
_GREEDY = ", ".join(
    ["g0 AS (SELECT pid, closed, target, 0::BIGINT AS chosen, (SELECT n FROM s WHERE m = 0) AS n FROM cl)"]
    + [
        f"g{i + 1} AS (SELECT pid, g.closed, target, coalesce(arg_min(s.m, s.n * {_N_ITEMS} + b), chosen) AS chosen, coalesce(min(s.n), g.n) AS n FROM g{i} g LEFT JOIN range({_N_ITEMS}) AS r(b) ON g.n > target AND (g.closed >> b) & 1 = 1 AND (chosen >> b) & 1 = 0 LEFT JOIN s ON s.m = chosen | (1::BIGINT << b) GROUP BY pid, g.closed, target, chosen, g.n)"
        for i in range(_N_ITEMS)
    ]
)


def _names(mask: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({mask} >> {j}) & 1 = 1 THEN '{j}' END" for j in range(_N_ITEMS)) + ")"


@query(
    f"WITH {_ITEMS}, w AS (SELECT ("
    + " + ".join(f"b{j}::INT * {1 << j}" for j in range(_N_ITEMS))
    + f")::BIGINT AS w, count(*) AS n FROM i GROUP BY 1), m AS (SELECT unnest(range({1 << _N_ITEMS}))::BIGINT AS m), s AS (SELECT m, coalesce(sum(n), 0)::BIGINT AS n, coalesce(bit_and(w), {(1 << _N_ITEMS) - 1}) AS closed FROM m LEFT JOIN w ON w & m = m GROUP BY m), "
    f"cl AS (SELECT b::INTEGER AS pid, closed, n AS target FROM range({_N_ITEMS}) AS r(b) JOIN s ON m = 1::BIGINT << b), {_GREEDY}, "
    f"e AS (SELECT pid, bit_count(min(cl.closed & ((1::BIGINT << b) - 1)))::INTEGER AS needed_end FROM cl JOIN range({_N_ITEMS + 1}) AS r(b) ON true JOIN s ON s.m = cl.closed & ((1::BIGINT << b) - 1) AND s.n = target GROUP BY pid) "
    f"SELECT pid, {_names('closed')} AS closure, needed_end, {_names('chosen')} AS minimal FROM g{_N_ITEMS} JOIN e USING (pid)"
)
def minimal_description(spark, sf_dir):
    n = len(ITEM_PREDICATES)
    table = cut(language.compress(lineitem_view(spark, sf_dir), ITEM_PREDICATES, {}), "signatures")
    sets = [c for _, c in language.closures(table, [(i,) for i in range(n)], n)]
    rows = [(i, ",".join(map(str, c)), end, ",".join(map(str, least))) for i, (c, end, least) in enumerate(zip(sets, language.needed_ends(table, sets, n), language.minimal_descriptions(table, sets, n)))]
    return spark.createDataFrame(rows, "pid int, closure string, needed_end int, minimal string")


# vector targets and kernels

_E = "e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_DIST = "list_sum([(a.x[d] - b.x[d]) * (a.x[d] - b.x[d]) FOR d IN range(1, len(a.x) + 1)])"
_RBF = f"exp(-({_DIST}) / 2)"


@query(f"WITH {_E} SELECT vec_id, round(list_sum([abs(v) FOR v IN x]), 6) AS norm1, round(sqrt(list_sum([v * v FOR v IN x])), 6) AS norm2, round(list_max([abs(v) FOR v IN x]), 6) AS norm_max FROM e")
def target_norms(spark, sf_dir):
    return embeddings_view(spark, sf_dir).select("vec_id", *(F.round(kernels.norm("embedding", p), 6).alias(n) for p, n in ((1.0, "norm1"), (2.0, "norm2"), (float("inf"), "norm_max"))))


@query(f"WITH {_E} SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.x, b.x), 6) AS k FROM e a JOIN e b ON a.vec_id <= b.vec_id")
def linear_gram(spark, sf_dir):
    return kernels.gram(embeddings_view(spark, sf_dir), "vec_id", "embedding", kernels.linear(), digits=6)


@query(f"WITH {_E} SELECT a.vec_id AS i, b.vec_id AS j, round({_RBF}, 6) AS k FROM e a JOIN e b ON a.vec_id <= b.vec_id")
def rbf_gram(spark, sf_dir):
    return kernels.gram(embeddings_view(spark, sf_dir), "vec_id", "embedding", kernels.rbf(1.0), digits=6)


@query(f"WITH {_E} SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)), 6) AS k FROM e a JOIN e b ON a.vec_id <= b.vec_id")
def kernel_normalise(spark, sf_dir):
    return kernels.gram(embeddings_view(spark, sf_dir), "vec_id", "embedding", kernels.linear(), normalise=True, digits=6)


@query(f"WITH {_E}, g AS (SELECT list_inner_product(a.x, b.x) AS k, {_RBF} AS l FROM e a CROSS JOIN e b) SELECT round(sum(k * l) / sqrt(sum(k * k) * sum(l * l)), 6) AS alignment FROM g")
def kernel_alignment(spark, sf_dir):
    e = embeddings_view(spark, sf_dir)
    sums = kernels.pair_sums(e, "vec_id", "embedding", (kernels.linear(), kernels.rbf(1.0)))
    return sums.select(F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 6).alias("alignment"))


_SUMS = f"WITH {_E}, s AS (SELECT a.label AS ga, b.label AS gb, sum({_RBF}) AS s FROM e a CROSS JOIN e b GROUP BY ALL), z AS (SELECT label AS g, count(*) AS n FROM e GROUP BY label), own AS (SELECT ga AS g, sum(s) AS m FROM s GROUP BY ga)"


@query(_SUMS + " SELECT ga, gb, round(s / (a.n * b.n), 6) AS k FROM s JOIN z a ON a.g = ga JOIN z b ON b.g = gb")
def mean_map_kernel(spark, sf_dir):
    e = embeddings_view(spark, sf_dir)
    sizes = e.groupBy(F.col("label").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return alignment.mean_map(kernels.group_sums(e, "vec_id", "embedding", "label", kernels.rbf(1.0)), sizes).select("ga", "gb", F.round("k", 6).alias("k"))


@query(_SUMS + " SELECT ga, gb, round(s / (a.m + b.m - s), 6) AS k FROM s JOIN own a ON a.g = ga JOIN own b ON b.g = gb")
def tanimoto_kernel(spark, sf_dir):
    e = embeddings_view(spark, sf_dir)
    return alignment.tanimoto(kernels.group_sums(e, "vec_id", "embedding", "label", kernels.rbf(1.0))).select("ga", "gb", F.round("k", 6).alias("k"))


def _mmd_sql(kernel: str, f: str) -> str:
    return f"WITH {_E}, s AS (SELECT a.label AS ga, b.label AS gb, sum({kernel}) AS s FROM e a CROSS JOIN e b GROUP BY ALL), z AS (SELECT label AS g, count(*) AS m FROM e GROUP BY label), n AS (SELECT count(*) AS n FROM e), t AS (SELECT sum(s) AS t FROM s), c AS (SELECT ga, sum(s) AS c, sum(s) FILTER (ga = gb) AS o FROM s GROUP BY ga) SELECT ga AS label, m AS n_rows, round((o - 2 * (m / n) * c + (m / n) * (m / n) * t) / ({f}), 6) AS score FROM c JOIN z ON g = ga, n, t"


def _mmd(spark, sf_dir, kernel: dict, anomaly: bool) -> DataFrame:
    return kernels.mean_deviation(embeddings_view(spark, sf_dir), "vec_id", "embedding", "label", kernel, anomaly=anomaly).select("label", F.col("n").alias("n_rows"), F.round("score", 6).alias("score"))


@query(_mmd_sql("list_inner_product(a.x, b.x)", "m * (n - m) / n"))
def mmd_linear_contrastive(spark, sf_dir):
    return _mmd(spark, sf_dir, kernels.linear(), False)


@query(_mmd_sql("list_inner_product(a.x, b.x)", "m"))
def mmd_linear_anomaly(spark, sf_dir):
    return _mmd(spark, sf_dir, kernels.linear(), True)


@query(_mmd_sql(_RBF, "m * (n - m) / n"))
def mmd_rbf_contrastive(spark, sf_dir):
    return _mmd(spark, sf_dir, kernels.rbf(1.0), False)


# vectors as the target of a search: predicates 0-9 labels, 10-12 components from a number on

VECTOR_PREDICATES: list[Predicate] = [
    *(Equals(Attribute("label", Kind.CATEGORICAL, position=0), category=str(v)) for v in range(10)),
    *(Ranged(Attribute(f"x{i}", Kind.NUMERICAL, position=1 + i), interval=Interval(0.0, None, name="positive")) for i in range(3)),
]
_VECTOR_TESTS = [*(f"label = '{v}'" for v in range(10)), *(f"x[{i + 1}] >= 0" for i in range(3))]
_VP = f"{_E}, p AS (" + " UNION ALL ".join(f"SELECT vec_id, {i} AS pid FROM e WHERE {c}" for i, c in enumerate(_VECTOR_TESTS)) + ")"


def _vectors(spark, sf_dir) -> DataFrame:
    return embeddings_view(spark, sf_dir).withColumns({f"x{i}": F.get("embedding", F.lit(i)) for i in range(3)})


@query(
    f"WITH {_VP}, c AS (SELECT CAST([] AS INTEGER[]) AS c, vec_id FROM e UNION ALL SELECT [pid], vec_id FROM p UNION ALL SELECT [a.pid, b.pid], a.vec_id FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.pid < b.pid), "
    "d AS (SELECT vec_id, unnest(x) AS v, unnest(range(len(x))) AS i FROM e), mu AS (SELECT i, avg(v) AS mu FROM d GROUP BY i), z AS (SELECT c, d.i, sum(v - mu) AS z, count(*) AS m FROM c JOIN d USING (vec_id) JOIN mu ON mu.i = d.i GROUP BY c, d.i), "
    "s AS (SELECT c, any_value(m) AS m, sum(z * z) AS q FROM z GROUP BY c), r AS (SELECT c, m, round(CASE WHEN m < n THEN q * n / (m * (n - m)) ELSE 0 END, 6) AS score FROM s, (SELECT count(*) AS n FROM e)) "
    "SELECT CAST(row_number() OVER (ORDER BY score DESC, len(c), c) AS INTEGER) AS rank, array_to_string(c, ',') AS indices, m AS n, score FROM r QUALIFY rank <= 5"
)
def mmd_topk_search(spark, sf_dir):
    found = search.search(_vectors(spark, sf_dir), VECTOR_PREDICATES, scores.Mmd("embedding"), scores.GroupedMmdBound("embedding"), 5, 2)
    return spark.createDataFrame([(i + 1, ",".join(map(str, f.indices)), f.n, round(f.score, 6)) for i, f in enumerate(found.best)], "rank int, indices string, n long, score double")


def _eigen(i: int, of: str) -> str:
    """The leading eigenvalue and vector of a matrix (i, j, v): a power of it, by squaring twelve times, and the quotient of its largest row."""
    return (
        f"p{i} AS (SELECT 0 AS t, i, j, v / (SELECT sum(v) FROM {of} WHERE i = j) AS v FROM {of} UNION ALL SELECT t, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (SELECT a.t + 1 AS t, a.i, b.j, sum(a.v * b.v) AS v FROM p{i} a JOIN p{i} b ON a.j = b.i WHERE a.t < 12 GROUP BY a.t, a.i, b.j)), "
        f"x{i} AS (SELECT j AS i, v / sqrt(sum(v * v) OVER ()) AS v FROM p{i} WHERE t = 12 AND i = (SELECT arg_max(i, v) FROM p{i} WHERE t = 12 AND i = j)), l{i} AS (SELECT sum(a.v * m.v * b.v) AS value FROM {of} m JOIN x{i} a ON a.i = m.i JOIN x{i} b ON b.i = m.j), "
        f"m{i} AS (SELECT m.i, m.j, m.v - value * a.v * b.v AS v FROM {of} m JOIN x{i} a ON a.i = m.i JOIN x{i} b ON b.i = m.j, l{i})"
    )


@query(
    f"WITH RECURSIVE {_E}, d AS (SELECT vec_id, unnest(x) AS v, unnest(range(len(x))) AS i FROM e), m AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i), {_eigen(1, 'm')}, {_eigen(2, 'm1')} "
    "SELECT CAST(1 AS INTEGER) AS rank, round(value, 6) AS value FROM l1 UNION ALL SELECT 2, round(value, 6) FROM l2"
)
def kernel_spectrum(spark, sf_dir):
    values, _ = spectra.leading(embeddings_view(spark, sf_dir), "vec_id", "embedding", kernels.linear(), rank=2, block=32)
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(values)], "rank int, value double")


@query(f"WITH {_E} SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.x, b.x) - avg(list_inner_product(a.x, b.x)) OVER (PARTITION BY a.vec_id, b.label), 6) + 0.0 AS k FROM e a CROSS JOIN e b")
def kernel_without_labels(spark, sf_dir):
    e = embeddings_view(spark, sf_dir).withColumn("flags", F.array(*((F.col("label") == str(v)).cast("double") for v in range(10))))
    found = spectra.without(e, "vec_id", "embedding", kernels.linear(), "flags", 10, digits=6)
    return found.select("i", "j", (F.col("k") + F.lit(0.0)).alias("k"))


@query(SQL["mmd_topk_search"])
def mmd_topk_histogram(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = search.search(rows, VECTOR_PREDICATES, scores.Mmd("embedding"), scores.MmdHistogramBound.of(rows, "embedding"), 5, 2)
    return spark.createDataFrame([(i + 1, ",".join(map(str, f.indices)), f.n, round(f.score, 6)) for i, f in enumerate(found.best)], "rank int, indices string, n long, score double")


@query()
def mmd_sd_bound(spark, sf_dir):
    return kernels.mean_deviation_bound(embeddings_view(spark, sf_dir), "embedding", "label").select("label", F.round("bound", 6).alias("bound"))


@query(f"WITH {_VP}, n AS (SELECT vec_id, count(*) AS n FROM p GROUP BY vec_id) SELECT a.vec_id AS i, b.vec_id AS j, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS k FROM p a JOIN p b ON a.pid = b.pid AND a.vec_id <= b.vec_id JOIN n x ON x.vec_id = a.vec_id JOIN n y ON y.vec_id = b.vec_id GROUP BY a.vec_id, b.vec_id")
def entity_similarity(spark, sf_dir):
    held = F.filter(F.array(*(F.when(p.column(), F.lit(i)) for i, p in enumerate(VECTOR_PREDICATES))), lambda x: x.isNotNull())
    return alignment.entity_similarity(_vectors(spark, sf_dir).select("vec_id", held.alias("on")), "vec_id", "on", digits=6)


@query(f"WITH {_E}, d AS (SELECT unnest(x) AS v, unnest(range(len(x))) AS i FROM e), c AS (SELECT list(mu ORDER BY i) AS c FROM (SELECT i, avg(v) AS mu FROM d GROUP BY i)) SELECT vec_id, round(sqrt(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])), 6) AS norm FROM e, c")
def centred_norm(spark, sf_dir):
    found = ingest.scalar_target(embeddings_view(spark, sf_dir), "embedding", "centred-norm")
    return found.select("vec_id", F.round("embedding_centred-norm2", 6).alias("norm"))


# kernels learnt from parts: a feature for each of four components, and all of them as one

FEATURES = {**{f"x{i}": [i] for i in range(4)}, "all": [0, 1, 2, 3]}
WIDTHS = [0.5, 1.0, 2.0]
_FEATURES = "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {at})" for n, at in FEATURES.items()) + ") AS f(feature, ats)), w AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS sigma)"


@query(
    f"WITH {_E}, {_FEATURES}, p AS (SELECT list_inner_product(a.x, b.x) AS t, [pow(a.x[i + 1] - b.x[i + 1], 2) FOR i IN range(4)] AS d FROM e a CROSS JOIN e b), "
    "k AS (SELECT feature, sigma, t, exp(-list_sum([d[i + 1] FOR i IN ats]) / (2 * sigma * sigma)) AS k FROM p, f, w) SELECT feature, sigma, round(sum(k * t) / sqrt(sum(k * k) * sum(t * t)), 6) AS alignment FROM k GROUP BY feature, sigma"
)
def sub_kernel_widths(spark, sf_dir):
    rated = learning.widths(embeddings_view(spark, sf_dir), "vec_id", "embedding", learning.grid(FEATURES, WIDTHS), kernels.linear())
    return rated.withColumn("alignment", F.round("alignment", 6))


@query(
    f"WITH {_E}, {_FEATURES}, p AS (SELECT list_inner_product(a.x, b.x) AS t, [pow(a.x[i + 1] - b.x[i + 1], 2) FOR i IN range(4)] AS d FROM e a CROSS JOIN e b), "
    "k AS (SELECT feature, sigma, t, exp(-list_sum([d[i + 1] FOR i IN ats]) / (2 * sigma * sigma)) AS k FROM p, f, w), r AS (SELECT feature, sigma, sum(k * t) / sqrt(sum(k * k) * sum(t * t)) AS alignment FROM k GROUP BY feature, sigma), "
    "best AS (SELECT feature, ats, sigma FROM r JOIN f USING (feature) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY alignment DESC, sigma) = 1), b AS (SELECT list(sigma ORDER BY feature) AS s, list(ats ORDER BY feature) AS ats, list(feature ORDER BY feature) AS names FROM best), "
    "q AS (SELECT t, [exp(-list_sum([d[i + 1] FOR i IN ats[z]]) / (2 * s[z] * s[z])) FOR z IN range(1, len(s) + 1)] AS k FROM p, b), z AS (SELECT unnest(range(1, len(s) + 1)) AS z FROM b), "
    "kk AS (SELECT x.z AS i, y.z AS j, sum(k[x.z] * k[y.z]) AS k FROM q, z x, z y GROUP BY ALL), kt AS (SELECT z AS i, sum(k[z] * t) AS v FROM q, z GROUP BY z), one AS (SELECT kt.i, v, greatest(v / sqrt(k), 0) AS a, row_number() OVER (ORDER BY v / sqrt(k) DESC) AS pos FROM kt JOIN kk ON kk.i = kt.i AND kk.j = kt.i), "
    "down AS (SELECT n.pos AS most, sum(x.a * y.a * k) AS own FROM one n JOIN one x ON x.pos <= n.pos JOIN one y ON y.pos <= n.pos JOIN kk ON kk.i = x.i AND kk.j = y.i GROUP BY n.pos), up AS (SELECT n.pos AS most, sum(x.a * x.v) AS with_t, sqrt(sum(x.a * x.a)) AS norm FROM one n JOIN one x ON x.pos <= n.pos GROUP BY n.pos), "
    "top AS (SELECT most, norm FROM down JOIN up USING (most) WHERE own > 0 ORDER BY with_t / sqrt(own) DESC, most LIMIT 1) SELECT names[i] AS feature, s[i] AS sigma, round(CASE WHEN pos <= most THEN a / norm ELSE 0 END, 6) AS weight FROM one, top, b"
)
def learned_kernel_weights(spark, sf_dir):
    found = learning.learn(embeddings_view(spark, sf_dir), "vec_id", "embedding", FEATURES, WIDTHS, kernels.linear())
    return spark.createDataFrame([(p.feature, p.sigma, round(p.weight, 6)) for p in found], "feature string, sigma double, weight double")


#: The best of 64 widths between 0.25 and 8, to three digits.
@query(
    f"WITH {_E}, f AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {at})" for n, at in FEATURES.items()) + ") AS f(feature, ats)), w AS (SELECT 0.25 * pow(32, i / 63) AS sigma FROM range(64) AS r(i)), "
    "p AS (SELECT list_inner_product(a.x, b.x) AS t, [pow(a.x[i + 1] - b.x[i + 1], 2) FOR i IN range(4)] AS d FROM e a CROSS JOIN e b), q AS (SELECT feature, t, list_sum([d[i + 1] FOR i IN ats]) AS d FROM p, f), "
    "r AS (SELECT feature, sigma, sum(exp(-d / (2 * sigma * sigma)) * t) / sqrt(sum(exp(-d / (sigma * sigma))) * sum(t * t)) AS alignment FROM q, w GROUP BY feature, sigma) SELECT feature, round(max(alignment), 3) AS alignment FROM r GROUP BY feature"
)
def sub_kernel_search(spark, sf_dir):
    tried = learning.search_widths(embeddings_view(spark, sf_dir), "vec_id", "embedding", FEATURES, 0.25, 8.0, kernels.linear())
    return spark.createDataFrame([(name, round(max(seen.values()), 3)) for name, seen in tried.items()], "feature string, alignment double")


_SETS = (
    f"WITH {_VP}, w AS (SELECT unnest([0, 1, 2])::INTEGER AS part, unnest([0.5, 1.0, 2.0])::DOUBLE AS sigma), "
    "q AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum([pow(a.x[d] - b.x[d], 2) FOR d IN [1, 2, 3, 4]]) AS d FROM e a CROSS JOIN e b), g AS (SELECT part, i, j, exp(-d / (2 * sigma * sigma)) AS k FROM q, w), "
    "h AS (SELECT part, i, b.pid AS b, sum(k) AS k FROM g JOIN p b ON b.vec_id = j GROUP BY ALL), s AS (SELECT part, a.pid AS a, b, sum(k) AS s FROM h JOIN p a ON a.vec_id = i GROUP BY ALL), "
    "r AS (SELECT part, i, sum(k) AS k FROM g GROUP BY ALL), m AS (SELECT part, pid AS a, sum(k) AS m FROM r JOIN p ON vec_id = i GROUP BY ALL), n AS (SELECT pid AS a, count(*) AS n FROM p GROUP BY pid), "
    "o AS (SELECT x.pid AS a, y.pid AS b, count(*) AS c FROM p x JOIN p y ON x.vec_id = y.vec_id GROUP BY ALL), t AS (SELECT u.a, v.a AS b, coalesce(c, 0) / (u.n + v.n - coalesce(c, 0)) AS t FROM n u CROSS JOIN n v LEFT JOIN o ON o.a = u.a AND o.b = v.a), "
    "z AS (SELECT part, s.a, s.b, s.s / (u.m + v.m - s.s) AS tanimoto, s.s / sqrt(x.s * y.s) AS normalised, s.s / (nu.n * nv.n) AS mean_map FROM (SELECT part, a, b, s FROM s) s JOIN m u USING (part, a) JOIN (SELECT part, a AS b, m FROM m) v USING (part, b) "
    "JOIN (SELECT part, a, s FROM s WHERE a = b) x USING (part, a) JOIN (SELECT part, b, s FROM s WHERE a = b) y USING (part, b) JOIN n nu USING (a) JOIN (SELECT a AS b, n FROM n) nv USING (b))"
)


@query(
    _SETS
    + " "
    + " UNION ALL ".join(f"SELECT '{how}' AS how, part, round(sum({c} * t) / sqrt(sum({c} * {c}) * (SELECT sum(t * t) FROM t)), 6) AS alignment FROM z JOIN t USING (a, b) GROUP BY part" for how, c in (("tanimoto", "tanimoto"), ("normalised", "normalised"), ("mean-map", "mean_map")))
)
def set_kernel_alignment(spark, sf_dir):
    held = F.filter(F.array(*(F.when(p.column(), F.lit(i)) for i, p in enumerate(VECTOR_PREDICATES))), lambda i: i.isNotNull())
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding", held.alias("on"))
    # a few sums of all pairs: written once, read for each kernel
    sums = cut(learning.set_sums(rows, "vec_id", "embedding", "on", len(VECTOR_PREDICATES), learning.grid({"all": FEATURES["all"]}, WIDTHS)), "sums")
    sizes = rows.select(F.explode("on").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    target = alignment.jaccard(rows.groupBy("on").agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("k", "t")
    out = None
    for how in ("tanimoto", "normalised", "mean-map"):
        one = learning.set_alignment(learning.set_kernel(sums, how, sizes), target).select(F.lit(how).alias("how"), "part", F.round("alignment", 6).alias("alignment"))
        out = one if out is None else out.unionByName(one)
    return out


# ingest


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_nationkey < 10 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def database_scan(spark, sf_dir):
    folder = f"{shared_folder(spark)}/database-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment")
    database.export(rows.repartitionByRange(4, "c_custkey"), folder, "customer", "c_custkey")
    found = database.scan(spark, folder, "customer", "c_custkey").where("c_acctbal >= 5000.0 and c_nationkey < 10 and c_mktsegment in ('BUILDING', 'MACHINERY')")
    return found.select("c_custkey", "c_name", "c_acctbal")


_PARTS = "SELECT k.c_custkey, c_acctbal, n_orders FROM (SELECT c_custkey, c_acctbal FROM customer) AS k {how} JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) AS p USING (c_custkey)"


def _parts(spark, sf_dir, how: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return ingest.assemble([a, b], "c_custkey", how)


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("outer", "FULL JOIN")):
    query(_PARTS.replace("{how} JOIN", _sql).replace("k.c_custkey", "c_custkey"), f"part_assembly_{_how}")(lambda spark, sf_dir, how=_how: _parts(spark, sf_dir, how))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def incremental_keys(spark, sf_dir):
    new = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ingest.missing(new, read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_properties(spark, sf_dir):
    return ingest.json_fields(read(spark, sf_dir, "events"), "props", {"k": "long"}).select("event_id", "k")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label, count(*) OVER (PARTITION BY o_orderpriority) AS n, TRY_CAST(o_orderpriority AS INTEGER) AS number FROM orders")
def value_labels(spark, sf_dir):
    return ingest.typed(ingest.with_labels(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").withColumn("number", F.col("o_orderpriority")), "o_orderpriority"), {"number": "int"}).select("o_orderkey", "label", "n", "number")


_SERIES = "s AS (SELECT user_id, list(value ORDER BY ts, value) AS v, count(*) AS length FROM events GROUP BY user_id)"


def _series(spark, sf_dir) -> DataFrame:
    return ingest.series(read(spark, sf_dir, "events"), "user_id", "ts", "value")


@query(f"WITH {_SERIES} SELECT user_id, CAST(length AS INTEGER) AS length, round(v[1], 6) AS first, round(v[len(v)], 6) AS last FROM s")
def series_collect(spark, sf_dir):
    return _series(spark, sf_dir).select("user_id", "length", F.round(F.get("values", F.lit(0)), 6).alias("first"), F.round(F.element_at("values", -1), 6).alias("last"))


@query(f"WITH {_SERIES}, c AS (SELECT length, count(*) AS c FROM s GROUP BY length) SELECT user_id, CAST(length AS INTEGER) AS length FROM s WHERE length = (SELECT length FROM c ORDER BY c DESC, length LIMIT 1)")
def modal_length(spark, sf_dir):
    return ingest.of_modal_length(_series(spark, sf_dir)).select("user_id", "length")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY user_id")
def group_rollup(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_click"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN log10(l_discount) END, 6) AS log_discount FROM lineitem")
def log_null_zero(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ingest.log10("l_discount"), 6).alias("log_discount"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def days_since(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", ingest.days_since("o_orderdate", "1992-01-01").alias("days"))


# the trade graph between nations

_G = "g AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL), f AS (SELECT CAST(n_nationkey AS BIGINT) AS vid, r_name AS feature FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _features(spark, sf_dir) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("vid"), F.col("r_name").alias("feature"))


@query(f"WITH {_G} SELECT src, dst, n FROM g WHERE src IN (SELECT vid FROM f WHERE feature = 'ASIA') AND dst IN (SELECT vid FROM f WHERE feature = 'ASIA')")
def induced_edges(spark, sf_dir):
    return graphs.induced(trade_edges(spark, sf_dir), _features(spark, sf_dir).where("feature = 'ASIA'")).select("src", "dst", "n")


@query(f"WITH {_G}, v AS (SELECT feature, count(*) AS n_vertices FROM f GROUP BY feature), m AS (SELECT a.feature, count(*) AS n_edges FROM g JOIN f a ON a.vid = src JOIN f b ON b.vid = dst AND a.feature = b.feature GROUP BY a.feature) SELECT feature, n_vertices, coalesce(n_edges, 0) AS n_edges, round(coalesce(n_edges, 0) / n_vertices, 6) AS density FROM v LEFT JOIN m USING (feature)")
def feature_density(spark, sf_dir):
    return graphs.feature_density(trade_edges(spark, sf_dir), _features(spark, sf_dir)).withColumn("density", F.round("density", 6))


# the graph of customers and suppliers, who meet in a line item: predicates 0-4 region, 5-6 balance from a number on

_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TRADE_PREDICATES: list[Predicate] = [
    *(Equals(Attribute("region", Kind.CATEGORICAL, position=0), category=v) for v in _REGIONS),
    *(Ranged(Attribute("balance", Kind.NUMERICAL, position=1), interval=Interval(float(m), None, name=f"from {m}")) for m in (0, 5000)),
]
_TRADE_TESTS = [*(f"rn = '{v}'" for v in _REGIONS), *(f"ab >= {m}" for m in (0, 5000))]
_T = (
    "w AS (SELECT n_nationkey AS nk, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey), v AS (SELECT CAST(c_custkey AS BIGINT) * 2 AS vid, rn, c_acctbal AS ab FROM customer JOIN w ON nk = c_nationkey UNION ALL SELECT CAST(s_suppkey AS BIGINT) * 2 + 1, rn, s_acctbal FROM supplier JOIN w ON nk = s_nationkey), "
    "e AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) * 2 AS src, CAST(l_suppkey AS BIGINT) * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), f AS (SELECT vid, rn AS feature FROM v)"
)
#: Conjunctions of up to two predicates with their vertices, and the edges between these, in either direction.
_TC = (
    _T + ", p AS (" + " UNION ALL ".join(f"SELECT vid, {i} AS pid FROM v WHERE {c}" for i, c in enumerate(_TRADE_TESTS)) + "), c AS (SELECT CAST([] AS INTEGER[]) AS c, vid FROM v UNION ALL SELECT [pid], vid FROM p UNION ALL SELECT [a.pid, b.pid], a.vid FROM p a JOIN p b ON a.vid = b.vid AND a.pid < b.pid), "
    "i AS (SELECT a.c, src, dst FROM u JOIN c a ON a.vid = src JOIN c b ON b.vid = dst AND a.c = b.c), d AS (SELECT src AS vid, count(*) AS d FROM u GROUP BY src), t AS (SELECT count(*) AS m, (SELECT count(*) FROM v) AS nv FROM e), "
    "s AS (SELECT c, n, vol, coalesce(m, 0) AS e FROM (SELECT c, count(*) AS n, coalesce(sum(d), 0) AS vol FROM c LEFT JOIN d USING (vid) GROUP BY c) LEFT JOIN (SELECT c, count(*) // 2 AS m FROM i GROUP BY c) USING (c))"
)


def _cores(group: str, edges: str) -> str:
    """The coreness within each group of edges (group, src, dst): h-indices of neighbours' values, again until none changes."""
    return (
        f"k AS (SELECT {group}, src AS vid, count(*) AS core, true AS changed FROM {edges} GROUP BY {group}, src UNION ALL "
        f"SELECT {group}, vid, new, bool_or(new <> old) OVER () FROM (SELECT n.{group}, n.vid, new, o.core AS old FROM (SELECT {group}, vid, max(least(core, r)) AS new FROM (SELECT x.{group}, x.src AS vid, y.core, row_number() OVER (PARTITION BY x.{group}, x.src ORDER BY y.core DESC) AS r FROM {edges} x JOIN k y ON y.{group} = x.{group} AND y.vid = x.dst WHERE y.changed) GROUP BY {group}, vid) n JOIN k o ON o.{group} = n.{group} AND o.vid = n.vid))"
        f", kc AS (SELECT {group}, vid, core FROM k WHERE NOT changed)"
    )


def _graph_top(value: str, more: str = "", of: str = "s") -> str:
    return f"WITH RECURSIVE {_TC}{more}, r AS (SELECT c, n, round({value}, 6) AS score FROM {of}, t) SELECT CAST(row_number() OVER (ORDER BY score DESC, len(c), c) AS INTEGER) AS rank, array_to_string(c, ',') AS indices, n, score FROM r QUALIFY rank <= 5"


def _graph_search(spark, sf_dir, measure: scores.Score, bound: scores.Score) -> DataFrame:
    found = search.search(trade_vertices(spark, sf_dir), TRADE_PREDICATES, measure, bound, 5, 2, edges=customer_supplier_edges(spark, sf_dir))
    return spark.createDataFrame([(i + 1, ",".join(map(str, f.indices)), f.n, round(f.score, 6)) for i, f in enumerate(found.best)], "rank int, indices string, n long, score double")


@query(_graph_top("e / n"))
def topk_edge_vertex_ratio(spark, sf_dir):
    return _graph_search(spark, sf_dir, scores.EdgeVertexRatio(), scores.EdgeVertexBound())


@query(_graph_top("e / m - (vol / (2 * m)) * (vol / (2 * m))"))
def topk_local_modularity(spark, sf_dir):
    return _graph_search(spark, sf_dir, scores.LocalModularity(), scores.LocalModularityBound())


@query(_graph_top("CASE WHEN least(vol, 2 * m - vol) > 0 THEN 1 - (vol - 2 * e) / least(vol, 2 * m - vol) ELSE 0 END"))
def topk_inverse_conductance(spark, sf_dir):
    return _graph_search(spark, sf_dir, scores.InverseConductance(), scores.InverseConductanceBound())


_COVERED = "g AS (SELECT c, n, coalesce(cores, 0) AS cores FROM s LEFT JOIN (SELECT c, sum(core) AS cores FROM kc GROUP BY c) USING (c))"


@query(_graph_top("sqrt(n / nv) * cores / n", f", {_cores('c', 'i')}, {_COVERED}", "g"))
def topk_average_coreness(spark, sf_dir):
    return _graph_search(spark, sf_dir, scores.AverageCoreness(gamma=0.5), scores.InducedAverageCoreness(gamma=0.5))


@query(f"WITH RECURSIVE {_T}, i AS (SELECT 0 AS g, src, dst FROM u), {_cores('g', 'i')} SELECT vid, CAST(core AS BIGINT) AS core FROM kc")
def coreness(spark, sf_dir):
    return graphs.coreness(customer_supplier_edges(spark, sf_dir))


def _trade_features(spark, sf_dir) -> DataFrame:
    return trade_vertices(spark, sf_dir).select("vid", F.col("region").alias("feature"))


@query(
    f"WITH RECURSIVE {_T}, ui AS (SELECT x.feature, src, dst FROM u JOIN f x ON x.vid = src JOIN f y ON y.vid = dst WHERE x.feature = y.feature), {_cores('feature', 'ui')}, "
    "d AS (SELECT src AS vid, count(*) AS d FROM u GROUP BY src), i AS (SELECT feature, count(*) / 2 AS m FROM ui GROUP BY feature), kk AS (SELECT feature, sum(core) AS s, max(core) AS top FROM kc GROUP BY feature), "
    "vv AS (SELECT feature, count(*) AS n, coalesce(sum(d), 0) AS vol FROM f LEFT JOIN d USING (vid) GROUP BY feature), t AS (SELECT count(*) / 2 AS t FROM u) "
    "SELECT feature, n AS n_vertices, CAST(coalesce(m, 0) AS BIGINT) AS n_edges, round(coalesce(m, 0) / n, 6) AS edge_vertex_ratio, round(CASE WHEN least(vol, 2 * t - vol) > 0 THEN 1 - (vol - 2 * coalesce(m, 0)) / least(vol, 2 * t - vol) ELSE 0 END, 6) AS inverse_conductance, "
    "round(coalesce(m, 0) / t - (vol / (2 * t)) * (vol / (2 * t)), 6) AS local_modularity, round(coalesce(s, 0) / n, 6) AS mean_coreness, CAST(coalesce(top, 0) AS BIGINT) AS max_coreness FROM vv LEFT JOIN i USING (feature) LEFT JOIN kk USING (feature), t"
)
def graph_measures(spark, sf_dir):
    found = graphs.group_measures(customer_supplier_edges(spark, sf_dir), _trade_features(spark, sf_dir).withColumnRenamed("feature", "group"))
    return found.select(F.col("group").alias("feature"), "n_vertices", "n_edges", *(F.round(c, 6).alias(c) for c in ("edge_vertex_ratio", "inverse_conductance", "local_modularity", "mean_coreness")), "max_coreness")


#: A vertex has one region, so a pattern has one feature and takes no edges from another.
@query(
    f"WITH {_T}, n AS (SELECT feature, count(*) AS n FROM f GROUP BY feature), i AS (SELECT x.feature, count(*) AS m FROM e JOIN f x ON x.vid = src JOIN f y ON y.vid = dst AND x.feature = y.feature GROUP BY x.feature) "
    "SELECT CAST(row_number() OVER (ORDER BY m / n DESC, feature) - 1 AS INTEGER) AS rank, feature AS features, n AS n_vertices, m AS n_edges, round(m / n, 6) AS density FROM n JOIN i USING (feature) QUALIFY rank < 3"
)
def communities(spark, sf_dir):
    found = graphs.communities(customer_supplier_edges(spark, sf_dir), _trade_features(spark, sf_dir), 3)
    return spark.createDataFrame([(i, "^".join(c["features"]), c["n_vertices"], c["n_edges"], round(c["density"], 6)) for i, c in enumerate(found)], "rank int, features string, n_vertices long, n_edges long, density double")


_WL = "SELECT vid, md5(concat_ws(':', label, CAST(coalesce(near, 0) AS VARCHAR))) AS label FROM {0} LEFT JOIN (SELECT src AS vid, sum(CAST(CAST('0x' || substr(md5(label), 1, 15) AS BIGINT) AS HUGEINT)) AS near FROM u JOIN {0} ON vid = dst GROUP BY src) USING (vid)"


@query(f"WITH {_T}, l0 AS (SELECT vid, feature AS label FROM f), l1 AS ({_WL.format('l0')}), l2 AS ({_WL.format('l1')}) SELECT vid, 0 AS round, label FROM l0 UNION ALL SELECT vid, 1, label FROM l1 UNION ALL SELECT vid, 2, label FROM l2")
def wl_labels(spark, sf_dir):
    return graphs.wl_labels(customer_supplier_edges(spark, sf_dir), _trade_features(spark, sf_dir).withColumnRenamed("feature", "label"), 2)


# the graphs of regions: customers and suppliers of one, labelled by role and sign of the balance

_RG = (
    f"{_T}, x AS (SELECT v.vid, rn AS g, concat_ws('/', CASE WHEN v.vid % 2 = 0 THEN 'customer' ELSE 'supplier' END, CAST(ab >= 0 AS VARCHAR)) AS label FROM v), "
    "ug AS (SELECT src, dst FROM u JOIN x a ON a.vid = src JOIN x b ON b.vid = dst AND a.g = b.g)"
)
_WG = _WL.replace("FROM u JOIN", "FROM ug JOIN")


@query(
    f"WITH {_RG}, l0 AS (SELECT vid, label FROM x), l1 AS ({_WG.format('l0')}), l2 AS ({_WG.format('l1')}), l AS (SELECT 0 AS r, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2), "
    "z AS (SELECT g, count(*) AS n FROM x GROUP BY g), h AS (SELECT g, r, l.label, count(*) / any_value(n) AS p FROM l JOIN x USING (vid) JOIN z USING (g) GROUP BY g, r, l.label), "
    "k AS (SELECT a.g AS a, b.g AS b, a.r, sum(least(a.p, b.p)) AS kept FROM h a JOIN h b ON a.r = b.r AND a.label = b.label GROUP BY ALL) "
    "SELECT a.g AS a, b.g AS b, round(exp(-2 * (1 - coalesce(sum(kept), 0) / 3)), 6) AS k FROM z a JOIN z b ON a.g <= b.g LEFT JOIN k ON k.a = a.g AND k.b = b.g GROUP BY a.g, b.g"
)
def graph_kernel(spark, sf_dir):
    v = trade_vertices(spark, sf_dir).select("vid", F.col("region").alias("graph"), F.concat_ws("/", "role", (F.col("balance") >= 0).cast("string")).alias("label"))
    found = graphs.wl_kernel(v, customer_supplier_edges(spark, sf_dir), "graph", rounds=2, gamma=2.0)
    return found.select("a", "b", F.round("k", 6).alias("k"))
