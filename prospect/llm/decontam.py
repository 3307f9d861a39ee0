"""Benchmark decontamination by containment search, with DataFrame functions only.

Texts become words (lower case, runs of letters and digits) and windows of five
words. A test item is short and a document may be very long, so their Jaccard
similarity says nothing; what counts is containment, the share of an item's
windows that a document has. Items are partitioned by size (powers of two of
their windows), and the partition sets the length of their sketches and the hits
that a document needs. An item gets a bottom-k MinHash sketch: its windows of
least hash, a uniform sample of them. Partitions of items under 32 windows have
whole items for sketches, and find them with certainty; larger ones have sketches
of 32, of 64 from 256 windows on, and need so many hits that an item contained at
the threshold is missed with a probability of at most ``MISS``. Candidates are
then verified: distinct windows, compared as text.

Sketches and the items' windows are broadcast only after their rows were
counted; above ``BROADCAST_ROWS`` the joins shuffle.

Edge cases: null and empty texts have no words; items and documents under five
words have no windows and match nothing; rows without an id are left out;
repeated rows (or an id with several texts) count as one set of windows; empty
tables give no rows. Columns besides the id and ``text`` are ignored.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORDS, CONTAINMENT = 5, 0.8
#: Partitions by size (the first power of two of their windows) and their sketches' lengths; how often an item at the threshold may be missed.
PARTITIONS, MISS = [(0, None), (5, 32), (8, 64)], 1e-6
BROADCAST_ROWS = 1 << 19
#: What stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " ")), " ")


def windows(column: str, hashed: bool) -> Column:
    """The windows of an array of words, as hashes or as text; an empty array if it is too short."""
    one = (lambda i: F.xxhash64(*(F.get(column, i + j) for j in range(WORDS)))) if hashed else (lambda i: F.concat_ws(" ", F.slice(column, i + 1, WORDS)))
    long_enough = F.size(column) >= WORDS
    return F.when(long_enough, F.transform(F.sequence(F.lit(0), F.size(column) - WORDS), one)).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def least_hits(sketched: int, share: float = CONTAINMENT) -> int:
    """Hits that a document with ``share`` of an item has among its sketch, but with probability ``MISS``."""
    below, k = 0.0, 0
    while k < sketched:
        below += comb(sketched, k) * share**k * (1 - share) ** (sketched - k)
        if below > MISS:
            break
        k += 1
    return max(1, k)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs with containment of ``share`` or more."""
    item_windows = (
        items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
        .select("item_id", F.explode(windows("w", False)).alias("shingle")).distinct()
        .withColumn("h", F.xxhash64(*(F.get(F.split("shingle", " "), F.lit(j)) for j in range(WORDS))))
    )
    item_windows = cut(item_windows, "items")
    sizes = item_windows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    # bottom-k sketches: per item the windows of least hash, as many as its partition says
    power, every = F.floor(F.log2("n_shingles")), F.ceil(F.col("n_shingles") * share - 1e-9).cast("int")
    length, need = F.col("n_shingles"), every
    for first, k in PARTITIONS[1:]:
        length, need = F.when(power >= first, F.lit(k)).otherwise(length), F.when(power >= first, F.lit(least_hits(k, share))).otherwise(need)
    low = Window.partitionBy("item_id").orderBy("h", "shingle")
    sketch = item_windows.join(sizes, "item_id").withColumn("at", F.row_number().over(low)).where(F.col("at") <= length)
    sketch = cut(sketch.select("item_id", need.alias("need"), "h").distinct(), "sketches")
    n_sketch, n_items = sketch.count(), item_windows.count()

    rows = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= WORDS)
    hits = rows.select("doc_id", F.explode(windows("w", True)).alias("h")).join(_small(sketch, n_sketch), "h")
    candidates = hits.groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("hits")).where("hits >= need").select("doc_id", "item_id")
    candidates = cut(candidates, "candidates")
    ids = candidates.select("doc_id").distinct()

    held = rows.join(_small(ids, candidates.count()), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(windows("w", False))).alias("shingle"))
    shared = held.join(_small(item_windows.select("item_id", "shingle"), n_items), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return (
        shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
        .select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
        .where(F.col("n_shared") >= share * F.col("n_shingles") - 1e-9)
    )


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; a row without an id stays, since nothing was found in it."""
    found = cut(contained(docs, items).select("doc_id").distinct(), "found")
    return docs.join(_small(found, found.count()), "doc_id", "left_anti").select(docs.columns)
