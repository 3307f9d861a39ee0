"""Conjunctions of predicates over rows that were added up by signature.

The predicates' truth is packed into words of 62 bits. Rows with equal words are
one row of the compressed table, with counts, sums and extremes; its size depends
on how many signatures there are, not on how many rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.functions.predicates import Predicate

WORD = 62


def packed(predicates: Sequence[Predicate]) -> Column:
    """The predicates' truth as an array of words."""
    words = []
    for at in range(0, len(predicates), WORD):
        bits = [F.when(p.column(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, p in enumerate(predicates[at : at + WORD])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return F.array(*words)


def mask(indices: Sequence[int], n: int) -> list[int]:
    out = [0] * ((n + WORD - 1) // WORD)
    for i in indices:
        out[i // WORD] |= 1 << (i % WORD)
    return out


def indices(words: Sequence[int]) -> tuple[int, ...]:
    return tuple(w * WORD + i for w, x in enumerate(words) for i in range(WORD) if x >> i & 1)


def compress(df: DataFrame, predicates: Sequence[Predicate], parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """(words, n, parts...): one row per signature."""
    rows = df.select(packed(predicates).alias("words"), *(c.alias(k) for k, (c, _) in parts.items()))
    return rows.groupBy("words").agg(F.count(F.lit(1)).alias("n"), *(added(k, how).alias(k) for k, (_, how) in parts.items()))


def added(part: str, how: str) -> Column:
    """The aggregate of a part: ``sum``, ``max``, or ``vector:n``, the sums of an array's n entries."""
    if how.startswith("vector:"):
        return F.array(*(F.sum(F.get(part, F.lit(i))) for i in range(int(how.removeprefix("vector:")))))
    return getattr(F, how)(part)


def holds(words: str, needed: str) -> Column:
    return F.expr(f"forall(zip_with({words}, {needed}, (w, m) -> (w & m) = m), x -> x)")


def set_bits(words: Column, n: int) -> Column:
    """The numbers below ``n`` whose bits are set, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", F.get(words, F.floor(i / WORD).cast("int")), i % WORD).bitwiseAND(F.lit(1).cast("long")) != 0)


def with_bit(words: Column, i: Column) -> Column:
    return F.transform(words, lambda w, at: F.when(at == F.floor(i / WORD), w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD))).otherwise(w))


def below(words: Column, i: Column) -> Column:
    """The bits below number ``i``."""
    at = F.floor(i / WORD)
    return F.transform(words, lambda w, k: F.when(k < at, w).when(k == at, w.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD) - 1)).otherwise(F.lit(0).cast("long")))


#: Candidates up to this number are sent to all tasks; more of them are dealt out, like the rows, by their last predicate.
SENT = 50_000


def met(table: DataFrame, candidates: DataFrame, n_predicates: int, few: bool) -> DataFrame:
    """The rows of ``table`` (words, ...) with each of the candidates (last, mask, ...) that they belong to.

    Rows meet candidates by the candidate's last predicate (-1: none), then by its mask.
    """
    own = table.withColumn("last", F.explode(F.concat(F.array(F.lit(-1)), set_bits(F.col("words"), n_predicates))))
    return own.join(F.broadcast(candidates) if few else candidates, "last").where(holds("words", "mask"))


def score(table: DataFrame, candidates: Sequence[tuple[int, ...]], n_predicates: int, parts: dict[str, str], closure: bool = False) -> DataFrame:
    """(cid, n, parts..., closure): sums of each candidate's rows, in one job; candidates without rows are absent."""
    known = table.sparkSession.createDataFrame([(i, c[-1] if c else -1, mask(c, n_predicates)) for i, c in enumerate(candidates)], "cid long, last int, mask array<long>")
    return met(table, known, n_predicates, len(candidates) <= SENT).groupBy("cid").agg(*sums(parts, n_predicates, closure))


def sums(parts: dict[str, str], n_predicates: int, closure: bool = False) -> list[Column]:
    """The aggregates of a candidate's rows; ``closure`` has the predicates that hold on all of them."""
    out = [F.sum("n").alias("n"), *(added(k, how).alias(k) for k, how in parts.items())]
    if closure:
        out.append(F.array(*(F.bit_and(F.get("words", F.lit(w))) for w in range(max(1, (n_predicates + WORD - 1) // WORD)))).alias("closure"))
    return out


def validate(predicates: Sequence[Predicate], chosen: Sequence[int]) -> Column:
    """The conjunction as a Column; the empty one holds for every row."""
    return reduce(lambda a, b: a & b, (predicates[i].column() for i in chosen), F.lit(True))


def parse(text: str, predicates: Sequence[Predicate]) -> tuple[int, ...]:
    """``{p1^p2}`` to indices, by the predicates' text."""
    text = text.strip()
    if not (text.startswith("{") and text.endswith("}")):
        raise ValueError(f"not a conjunction: {text!r}")
    known = {str(p): i for i, p in enumerate(predicates)}
    out = []
    for part in filter(None, (x.strip() for x in text[1:-1].split("^"))):
        if part not in known:
            raise ValueError(f"no predicate {part!r} in {text!r}")
        out.append(known[part])
    return tuple(sorted(set(out)))


def render(chosen: Sequence[int], predicates: Sequence[Predicate]) -> str:
    return "{" + "^".join(str(predicates[i]) for i in chosen) + "}"


def closures(table: DataFrame, candidates: Sequence[tuple[int, ...]], n_predicates: int) -> list[tuple[int, tuple[int, ...]]]:
    """(support, closure) of each candidate: all predicates that hold on all its rows. No rows: support 0 and all predicates."""
    got = {r["cid"]: r for r in score(table, candidates, n_predicates, {}, closure=True).collect()}
    return [(got[i]["n"], indices(got[i]["closure"])) if i in got else (0, tuple(range(n_predicates))) for i in range(len(candidates))]


def on_some_row(table: DataFrame, candidates: Sequence[tuple[int, ...]], n_predicates: int) -> list[tuple[int, ...]]:
    """For each candidate the predicates that hold on one of its rows at least, as ``closures`` has those that hold on all; one job for all."""
    known = table.sparkSession.createDataFrame([(i, c[-1] if c else -1, mask(c, n_predicates)) for i, c in enumerate(candidates)], "cid long, last int, mask array<long>")
    words = F.array(*(F.bit_or(F.get("words", F.lit(w))) for w in range(max(1, (n_predicates + WORD - 1) // WORD))))
    got = {r["cid"]: r["any"] for r in met(table, known, n_predicates, len(candidates) <= SENT).groupBy("cid").agg(words.alias("any")).collect()}
    return [indices(got.get(i, ())) for i in range(len(candidates))]


def needed_ends(table: DataFrame, closed: Sequence[Sequence[int]], n_predicates: int) -> list[int]:
    """For each closure the length of the shortest prefix, sorted, with the same rows; one job for all."""
    prefixes = [[tuple(sorted(c)[:i]) for i in range(len(c) + 1)] for c in closed]
    distinct = sorted({p for each in prefixes for p in each})
    support = dict(zip(distinct, (n for n, _ in closures(table, distinct, n_predicates))))
    return [next(i for i, p in enumerate(each) if support[p] == support[each[-1]]) for each in prefixes]


def needed_end(table: DataFrame, closed: Sequence[int], n_predicates: int) -> int:
    """The length of the shortest prefix of the sorted closure with the same rows."""
    return needed_ends(table, [closed], n_predicates)[0]


def minimal_descriptions(table: DataFrame, closed: Sequence[Sequence[int]], n_predicates: int) -> list[tuple[int, ...]]:
    """Greedy, for all closures at once, a job for each step: again and again the predicate that leaves the fewest rows, until they are the closure's."""
    closed = [tuple(sorted(c)) for c in closed]
    first = [(), *dict.fromkeys(closed)]
    support = dict(zip(first, (n for n, _ in closures(table, first, n_predicates))))
    chosen: list[tuple[int, ...]] = [()] * len(closed)
    while open_ := [i for i, c in enumerate(closed) if support[chosen[i]] > support[c]]:
        steps = {i: [tuple(sorted((*chosen[i], p))) for p in closed[i] if p not in chosen[i]] for i in open_}
        new = sorted({s for each in steps.values() for s in each} - support.keys())
        support |= zip(new, (n for n, _ in closures(table, new, n_predicates))) if new else {}
        for i, each in steps.items():
            chosen[i] = min(each, key=lambda s: support[s])  # of equal ones the lowest predicate
    return chosen


def minimal_description(table: DataFrame, closed: Sequence[int], n_predicates: int) -> tuple[int, ...]:
    """Greedy: again and again the predicate of the closure that leaves the fewest rows, until they are the closure's."""
    return minimal_descriptions(table, [closed], n_predicates)[0]


def supersets(table: DataFrame, n_predicates: int) -> DataFrame:
    """(a, b): b holds wherever a does, a is not empty and not b."""
    each = table.select("n", F.filter(F.array(*(F.when(F.get("words", F.lit(j // WORD)).bitwiseAND(F.lit(1 << (j % WORD)).cast("long")) != 0, F.lit(j)) for j in range(n_predicates))), lambda x: x.isNotNull()).alias("on"))
    pairs = each.select("n", "on", F.explode("on").alias("a")).select("n", "a", F.explode("on").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("both"))
    alone = pairs.where("a = b").select("a", F.col("both").alias("own"))
    return pairs.where("a <> b").join(alone, "a").where("both = own").select("a", "b")


def closed_parent(table: DataFrame, closed: Sequence[int], n_predicates: int) -> tuple[int, ...] | None:
    """The closed set that the prefix-preserving tree reaches ``closed`` from: the closure of the prefix before its needed end; None at the root."""
    closed = sorted(closed)
    end = needed_end(table, closed, n_predicates)
    return None if end == 0 else closures(table, [tuple(closed[: end - 1])], n_predicates)[0][1]


def closed_refinements(table: DataFrame, closed: Sequence[int], n_predicates: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(predicate, support, closure): what one more predicate makes of a closed set.

    Of the predicates with the same closure the least stands for all; closures
    without rows are none. Least support first.
    """
    others = [i for i in range(n_predicates) if i not in set(closed)]
    best: dict[tuple[int, ...], tuple[int, int]] = {}
    for i, (support, of) in zip(others, closures(table, [tuple(sorted((*closed, i))) for i in others], n_predicates)):
        if support and of not in best:
            best[of] = (i, support)
    return sorted(((i, n, of) for of, (i, n) in best.items()), key=lambda r: (r[1], r[0]))
