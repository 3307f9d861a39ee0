"""A Merkle manifest of a table: leaf digests, one tree a language, one tree over these, proofs.

Higher-order SQL blocks: nodes get their place by a distributed ranking and are
gathered in blocks of ``BLOCK`` consecutive ones; within a block ``aggregate``
stacks level on level, each by ``transform`` over a ``sequence`` of pairs that
``slice`` takes from the level below. A block whose tree goes on above it is
collapsed by exactly log2(``BLOCK``) levels, so that its root is a node of the tree;
the block roots are the nodes of the next round, until each tree has one. Then the
paths are handed down, from the root of all trees to the leaves.

Digests are lowercase hexadecimal SHA-256 of what they cover, one after another. A
node without a neighbour is digested alone, while its level has several nodes.

Edge cases: a null field is ``-`` in its leaf, others are their length in bytes,
``:`` and their value, so an empty text is not a null one; a null language is a tree
of its own, and null ids come first; rows of one id are ordered by their leaves, so
repeated rows are told apart by nothing but place; a very long text meets only its own
digest; an empty table gives no rows. Columns besides ``FIELDS`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a block: a power of two.
LEVELS = 10
BLOCK = 1 << LEVELS
#: One document in so many has its leaf tampered with, to see that its proof fails.
TAMPER = 7


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(values[f]) for f in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, row, tampered): ``tampered`` is the leaf with one more character, null where it stays as it is.

    ``tree`` is a language's name behind ``=``, and ``-`` for none: never null, and in the languages' order. ``row``
    tells repeated rows apart, so that many of them need not share a range.
    """
    values = {f: F.col(f) for f in FIELDS}
    more = F.expr("cast(try_cast(n_chars as decimal(38, 0)) + 1 as string)")
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), "doc_id", leaf(values).alias("digest"), F.monotonically_increasing_id().alias("row"),
        F.when(chosen, leaf(values | {"n_chars": F.coalesce(more, F.col("n_chars").cast("string"))})).alias("tampered"),
    )


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, ...) with ``place``, from 0 within each tree by ``order``, without a task that holds a whole tree.

    Rows are dealt out by ranges of tree and order, and numbered in each range; the
    ranges' counts, summed up, say where each begins. The ranges are written first:
    what they are is sampled, and must not differ between count and rows.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(n, "tree", *order).withColumn("span", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    within = Window.partitionBy("span", "tree")
    before = Window.partitionBy("tree").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("span", "tree").agg(F.count("*").alias("n")).select("span", "tree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = ranged.withColumn("number", F.row_number().over(within.orderBy(*order)) - 1)
    return numbered.join(starts, ["span", "tree"]).withColumn("place", F.col("start") + F.col("number")).drop("span", "start", "number")


def _pairs(level: Column) -> Column:
    """The level above a level: a digest of each two consecutive nodes, of one where a second is missing."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: F.sha2(F.array_join(F.slice(level, 2 * i + 1, F.lit(2)), ""), 256))


def _stack(nodes: Column, levels: Column) -> Column:
    """The nodes and the levels above them, ``levels`` of them: an array of arrays."""
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda found, _: F.concat(found, F.array(_pairs(F.element_at(found, -1)))))


def blocks(nodes: DataFrame, rest: list[str]) -> DataFrame:
    """(tree, block, ends, nodes, stack, top): the blocks of each tree.

    ``nodes`` holds ``rest`` of each node in order, ``stack`` the digests of all levels, ``top`` that of the block's
    root. A first block that isn't full is its tree's only one, and ``ends`` it. A full one goes on, alone or not:
    alone, it is the only node of the next round, which is its own root.
    """
    own = F.floor(F.col("place") / BLOCK).alias("block")
    gathered = nodes.groupBy("tree", own).agg(F.array_sort(F.collect_list(F.struct("place", "digest", *rest))).alias("nodes"))
    n = F.size("nodes")
    ended = gathered.withColumn("ends", (F.col("block") == 0) & (n < BLOCK))
    levels = F.when(~F.col("ends"), LEVELS).when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    stacked = ended.withColumn("stack", _stack(F.col("nodes.digest"), levels))
    return stacked.select("tree", "block", "ends", "nodes", "stack", F.element_at(F.element_at("stack", -1), 1).alias("top"))


def _path(stack: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` and of those above it, level by level, below the block's root; empty where nothing does."""
    steps = F.when(F.size(stack) > 1, F.sequence(F.lit(0), F.size(stack) - 2)).otherwise(F.array().cast("array<int>"))

    def sides(level):
        at = F.call_function("shiftright", i, level)
        row = F.get(stack, level)
        odd = at % 2 == 1
        return F.struct(F.when(odd, F.get(row, at - 1)).otherwise("").alias("left"), F.when(odd, "").otherwise(F.coalesce(F.get(row, at + 1), F.lit(""))).alias("right"))

    return F.transform(steps, sides)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    return F.aggregate(path, node, lambda below, side: F.sha2(F.concat(side["left"], below, side["right"]), 256))


def proof(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), "")


def grown(nodes: DataFrame, rest: list[str]) -> list[DataFrame]:
    """The written blocks of each round, from the nodes (tree, place, digest, ...) until every tree has ended."""
    rounds = []
    while True:
        rounds.append(made := cut(blocks(nodes, rest), "blocks"))
        going = made.where(~F.col("ends"))
        if going.isEmpty():
            return rounds
        nodes, rest = going.select("tree", F.col("block").alias("place"), F.col("top").alias("digest")), []


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top): the root of each tree, from the round in which it ended."""
    return reduce(DataFrame.unionByName, [r.where("ends").select("tree", "top") for r in rounds])


def handed_down(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of the first round with ``path``: their own in the block, that of the block's root in the rounds above, and ``above``.

    ``above`` (tree, path, ...) is what follows each tree's root; its columns ``carried`` are handed down too.
    """
    later = None
    for made in reversed(rounds):
        came = made.where("ends").join(above, "tree")
        if later is not None:
            came = came.unionByName(made.where(~F.col("ends")).join(later, ["tree", "block"]))
        own = F.transform("nodes", lambda node, i: F.struct(node.alias("node"), F.concat(_path(F.col("stack"), i), F.col("path")).alias("path")))
        spread = came.select("tree", *carried, F.explode(own).alias("_one"))
        out = spread.select("tree", *carried, "_one.path", "_one.node.*")
        later = out.withColumnRenamed("place", "block").drop("digest")
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    own = grown(placed(leaves(docs), ["doc_id", "digest", "row"]), ["doc_id", "tampered"])
    subroots = cut(roots(own), "subroots")
    # the trees' roots are the nodes of one more tree, in the order of their names
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    over = grown(placed(names, ["name"]), ["name"])
    end = roots(over).select("tree", F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = handed_down(over, end, ["root"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    found = handed_down(own, tops, ["subroot", "root"])
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
