"""Closed sets by restricted refinement over vertical bitmaps.

Signatures are numbered in ranges of 62, one bit each; a predicate has a word of bits in each range
where it holds. A refinement's bits are its parent's and the predicate's together, so
neither rows nor signatures are read again to find them, and each level is a written table.

The refinements of a closed set with the same closure are one. They are taken least support
first, and each bars what came before it (the superset sets of these among them) from its
own refinements: what contains a barred predicate was reached there. So each closed set is visited once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.sources.scratch import cut

from .language import WORD, set_bits, with_bit


def _each(words: int, of) -> Column:
    return F.array(*(of(w) for w in range(words)))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _disjoint(a: str, b: str) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) == 0), lambda x: x)


def vertical(table: DataFrame, n_predicates: int) -> tuple[DataFrame, DataFrame]:
    """(range, p, bits): where each predicate holds; (range, rows): the signatures (bit, n, words) of each range."""
    own = cut(table.where("n > 0").select("words", "n").withColumn("_id", F.monotonically_increasing_id()), "signatures")
    own = own.select(F.floor(F.col("_id") / WORD).alias("range"), (F.col("_id") % WORD).cast("int").alias("bit"), "words", "n")
    bits = own.select("range", "bit", F.explode(set_bits(F.col("words"), n_predicates)).alias("p")).groupBy("range", "p").agg(F.bit_or(_bit(F.col("bit"))).alias("bits"))
    return cut(bits, "vertical"), cut(own.groupBy("range").agg(F.collect_list(F.struct("bit", "n", "words")).alias("rows")), "ranges")


def restricted(table: DataFrame, n_predicates: int, least: int = 1) -> DataFrame:
    """(items, n): every closed set of a table (words, n) with its support, if that is ``least`` or more."""
    words = max(1, (n_predicates + WORD - 1) // WORD)
    bits, ranges = vertical(table, n_predicates)
    none = _each(words, lambda w: F.lit(0).cast("long"))
    every = _each(words, lambda w: F.lit((1 << WORD) - 1).cast("long"))

    def held(rows: DataFrame) -> DataFrame:
        """What the bits of each range add: how many rows, and what all of them have."""
        on = F.filter("rows", lambda r: F.call_function("shiftright", F.col("bits"), r["bit"]).bitwiseAND(F.lit(1).cast("long")) != 0)
        n = F.aggregate(on, F.lit(0).cast("long"), lambda a, r: a + r["n"])
        common = F.aggregate(on, every, lambda a, r: F.zip_with(a, r["words"], lambda x, y: x.bitwiseAND(y)))
        return rows.join(ranges, "range").withColumns({"n": n, "common": common}).drop("rows")

    support, closure = F.sum("n").alias("n"), _each(words, lambda w: F.bit_and(F.get("common", F.lit(w)))).alias("closure")
    whole = ranges.select("range", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a.bitwiseOR(_bit(r["bit"]))).alias("bits"))
    root = cut(held(whole).agg(support, closure).where(F.col("n") >= least), "closed")
    found, nodes = [root.select("closure", "n")], whole.join(F.broadcast(root.select(F.col("closure").alias("mask"), none.alias("barred"))), F.lit(True))  # one row
    while True:
        made = nodes.join(bits.withColumnRenamed("bits", "own"), "range").where(_disjoint_from("p", "mask") & _disjoint_from("p", "barred"))
        made = cut(made.withColumn("bits", F.col("bits").bitwiseAND(F.col("own"))).where("bits <> 0").select("mask", "barred", "p", "range", "bits"), "refined")
        each = held(made).groupBy("mask", "barred", "p").agg(support, closure)
        each = each.groupBy("mask", "barred", "closure").agg(F.min("p").alias("p"), F.first("n").alias("n"), F.collect_list("p").alias("same"))
        each = each.withColumn("same", F.aggregate("same", none, lambda a, p: with_bit(a, p)))
        before = Window.partitionBy("mask").orderBy("n", "p").rowsBetween(Window.unboundedPreceding, -1)  # a row a predicate at most
        earlier = _each(words, lambda w: F.coalesce(F.bit_or(F.get("same", F.lit(w))).over(before), F.lit(0).cast("long")))
        each = each.withColumn("barred", F.zip_with("barred", earlier, lambda x, y: x.bitwiseOR(y)))
        kept = cut(each.where(_disjoint("closure", "barred") & (F.col("n") >= least)).select("mask", "p", "closure", "barred", "n"), "closed")
        if kept.isEmpty():
            break
        found.append(kept.select("closure", "n"))
        nodes = kept.select("mask", "p", F.col("closure").alias("_mask"), F.col("barred").alias("_barred")).join(made.drop("barred"), ["mask", "p"]).select(F.col("_mask").alias("mask"), F.col("_barred").alias("barred"), "range", "bits")
    return reduce(DataFrame.unionByName, found).select(set_bits(F.col("closure"), n_predicates).alias("items"), "n")


def _disjoint_from(p: str, mask: str) -> Column:
    """That a predicate's bit isn't set."""
    return F.call_function("shiftright", F.get(mask, F.floor(F.col(p) / WORD).cast("int")), (F.col(p) % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 0
