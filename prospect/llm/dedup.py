"""Near-duplicates by DartMinHash: sparse weighted signatures and banded joining.

A text is the weighted set of its windows of five words (lower case, split at
white space), the weight being how often a window occurs. Two texts are near
copies if their weighted Jaccard similarity is 0.8 or more.

Signatures (after Christiani, "DartMinHash: Fast Sketching for Weighted Sets",
2020): darts fall on the plane of weight times rank with density 1, by a hash of
the element and the unit of weight, and each goes to one of ``COORDINATES``. A
text keeps, per coordinate, the dart of least rank that falls within its
elements' weights. Only darts up to rank t / W matter, W being the total weight,
so a text costs its length plus some hundred darts.

Texts that share all coordinates of a band are candidates; buckets are never
expanded to pairs. First every text is compared with one text of each of its
buckets, that which shares most buckets with others (among copies that differ
from each other, the one they come from), so that a group of copies, however
large, costs as many comparisons as it has texts. The links' components are then
most of the classes. The texts of buckets that still hold several components are
joined exactly: windows have one order, rare ones first, and two near copies share
one among the first that make up the part of each that the other may lack, with
enough left behind it, so no pair is lost. Any order will do; this one counts
windows in ``CELLS`` cells, so that common passages come last. Of a window's texts
those of its largest component never meet each other. Nothing is capped. Pairs are
verified exactly, and the links' components are the classes.

Edge cases: equal texts are always one class, whatever their length; a null
text is an empty one; texts under five words have no windows and match equal
texts only; a very long text is signed and compared as a whole. Rows without an
id are left out; an id that occurs more than once gives one row, and its texts
share a class. Ids may be of any type that Spark sorts. An empty table gives no
rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, cut, discard, encode, mix, shingles
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Cells that windows are counted in to order them: 8 MB.
CELLS = 1 << 20
#: Ids that may be broadcast: 8 MB.
BROADCAST_IDS = 1 << 20
#: Of two near copies' sizes added, the part that they share at least.
SHARE = SIMILARITY / (1 + SIMILARITY)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted(text: str, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of five words, as hashes, and how often each occurs."""
    return np.unique(shingles(words.of(encode(text.lower()).split()), WORDS), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of ``COORDINATES`` 32-bit values per weighted set; weights are whole and sets not empty."""
    k = COORDINATES
    best = np.full(len(sets) * k, _NONE, np.uint64)
    if not sets:
        return np.empty((0, k), np.uint32)
    sizes = np.array([len(x) for x, _ in sets])
    hashes, counts = np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    total = np.bincount(owner, counts, len(sets))
    # a seed for each unit of weight: the region [j, j + 1) of an element's weight
    unit = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    seed, owner = mix(np.repeat(hashes, counts) ^ mix(unit.astype(np.uint64) + np.uint64(1))), np.repeat(owner, counts)
    wanted = np.ones(len(sets), bool)
    reach = k * (np.log(k) + 3.0)
    while wanted.any():
        on = wanted[owner]
        s, o = seed[on], owner[on]
        most = reach / total[o]
        rank, turn = np.zeros(len(s)), 0
        while len(s):
            turn += 1
            h = mix(s + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_uniform(h))  # ranks of a region's darts: unit-rate arrivals
            on = rank <= most
            s, o, rank, most, h = s[on], o[on], rank[on], most[on], mix(h[on])
            value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, o * k + ((h >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)
        wanted = (best.reshape(-1, k) == _NONE).any(axis=1)
        reach *= 2
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, k)


def _folded(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of the last axis."""
    out = np.full(values.shape[:-1], salt, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(values.shape[-1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[..., i].astype(np.uint64))
    return out.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch, texts in chunks(batches):
        sets = [weighted(t, words) for t in texts]
        has = np.array([len(x) > 0 for x, _ in sets], bool)
        found = signatures([x for x in sets if len(x[0])])
        keys = iter(_folded(found.reshape(-1, BANDS, ROWS), 1).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([next(keys) if x else None for x in has], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "bands"],
        )


def _units(text: str, words: WordHashes) -> np.ndarray:
    """A hash for each unit of weight: as plain sets, two texts' units are as similar as their weighted sets."""
    hashes, counts = weighted(text, words)
    unit = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(hashes, counts) ^ mix(unit.astype(np.uint64) + np.uint64(1)))


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, total = WordHashes(), np.zeros(CELLS, np.int64)
    for _, texts in chunks(batches):
        for text in texts:
            np.add.at(total, (_units(text, words) % np.uint64(CELLS)).astype(np.int64), 1)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def _first_units(counts):
    """(rep, size, at, short, unit): the units of each text by their order, as many as a near copy cannot lack all of.

    ``short``: whether a near copy of at least its size shares one up to there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in chunks(batches):
            rows, sizes, places, units = [], [], [], []
            for i, text in enumerate(texts):
                x = _units(text, words)
                n = counts.value[(x % np.uint64(CELLS)).astype(np.int64)]
                order = np.lexsort((x, n))[: len(x) - int(np.ceil(SIMILARITY * len(x) - 1e-9)) + 1]
                at = np.flatnonzero(n[order] > 1)  # what is alone in its cell is in no other text
                rows.append(np.full(len(at), i))
                sizes.append(np.full(len(at), len(x), np.int64))
                places.append(at)
                units.append(x[order[at]].view(np.int64))
            size, place = np.concatenate(sizes), np.concatenate(places)
            short = place <= size - np.ceil(2 * SHARE * size - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(np.concatenate(rows))), *map(pa.array, (size, place, short, np.concatenate(units)))], ["rep", "size", "at", "short", "unit"])

    return run


def _exact_pairs(texts: DataFrame, comp: DataFrame) -> DataFrame:
    """(lead, rep): pairs of different components, all near copies among ``texts`` (rep, text) included."""
    counted = texts.mapInArrow(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    first = texts.mapInArrow(_first_units(shared), f"rep {dict(texts.dtypes)['rep']}, size long, at long, short boolean, unit long")
    first = cut(_with_comp(first, comp), "units")
    # units of several components, and the one with most texts
    each = first.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = cut(each.groupBy("unit").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("unit", F.col("m.comp").alias("most")), "most")
    met = cut(first.join(most, "unit").withColumn("inner", F.col("comp") == F.col("most")).drop("most"), "met")
    a = met.where("short").select("unit", *(F.col(c).alias("a_" + c) for c in ("rep", "comp", "size", "at", "inner")))
    outer = a.join(met.where("not inner"), "unit")
    inner = a.where("not a_inner").join(met.where("inner"), "unit")
    # the first unit that two near copies share leaves enough behind it on both sides
    enough = F.least(F.col("a_size") - F.col("a_at"), F.col("size") - F.col("at")) >= SHARE * (F.col("a_size") + F.col("size")) - 1e-6
    found = outer.unionByName(inner).where((F.col("a_comp") != F.col("comp")) & (F.col("a_size") <= F.col("size")) & enough)
    return found.select(F.least("a_rep", "rep").alias("lead"), F.greatest("a_rep", "rep").alias("rep")).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact weighted Jaccard similarity of each pair's texts."""
    words, last = WordHashes(), (None, None)
    for batch in batches:
        left, right = batch.column("text_lead"), batch.column("text_rep")
        out = []
        for i in range(batch.num_rows):
            a = left[i].as_py()
            if last[0] != a:
                last = (a, weighted(a, words))
            (xa, wa), (xb, wb) = last[1], weighted(right[i].as_py(), words)
            _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
            both = int(np.minimum(wa[ia], wb[ib]).sum())
            out.append(both / max(1, int(wa.sum() + wb.sum()) - both))
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("rep"), pa.array(out, pa.float64())], ["lead", "rep", "similarity"])


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (lead, rep) that are near copies."""
    both = pairs.join(texts.select("rep", F.col("text").alias("text_rep")), "rep").join(texts.select(F.col("rep").alias("lead"), F.col("text").alias("text_lead")), "lead")
    kind = dict(pairs.dtypes)["rep"]
    rated = both.select("lead", "rep", "text_lead", "text_rep").mapInArrow(_verify, f"lead {kind}, rep {kind}, similarity double")
    return cut(rated.where(F.col("similarity") >= SIMILARITY).select(F.col("lead").alias("a"), F.col("rep").alias("b")), "links")


def linked(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(rep, comp): the component of each text that has a near copy, by its least rep.

    ``signed`` has a row (rep, bands) for each text, ``docs`` its text by doc_id.
    """
    rows = signed.select("rep", F.posexplode("bands").alias("band", "at")).select("rep", F.xxhash64("band", "at").alias("key"))
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    rows = cut(rows.join(sizes, "key"), "bands")
    discard(sizes)
    # only texts with a candidate are ever read again; how many candidates a text has tells the centre of a group of copies
    ids = cut(rows.groupBy("rep").agg(F.sum("n").alias("near")), "ids")
    many = ids.count()
    few = F.broadcast(ids.select("rep")) if many <= BROADCAST_IDS else ids.select("rep")
    texts = cut(docs.join(few, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text"), "texts")
    if texts.count() > many:  # repeated rows, or ids with several texts
        texts = cut(texts.dropDuplicates(), "texts")
    leads = cut(rows.join(ids, "rep").groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("near"), "rep")).alias("top")).select("key", F.col("top.rep").alias("lead")), "leads")
    links = _links(rows.join(leads, "key").where("rep <> lead").select("lead", "rep").distinct(), texts)
    comp = cut(components(links).select(F.col("node").alias("rep"), F.col("component").alias("comp")), "components")
    # buckets with several components
    now = _with_comp(rows.select("rep", "key"), comp)
    keys = cut(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "contested")
    again = rows.join(keys, "key").select("rep").distinct()
    rest = cut(texts.join(again, "rep", "left_semi"), "rest")
    if rest.isEmpty():
        return comp
    more = _links(_exact_pairs(rest, comp), texts)
    if more.isEmpty():
        return comp
    return components(links.unionByName(more)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): a class is named by its least id."""
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("text_key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    signed = cut(keyed.select("doc_id", "text_key", "text").mapInArrow(_sign, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key binary, bands array<long>"), "signed")
    # equal texts: one stands for all
    same = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key", "rep")
    same = cut(same, "same")  # a table of its own, so that Spark may split a hot text's rows in the join
    member = cut(signed.join(same, "text_key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "bands"), "members")
    one = member.where("doc_id = rep and bands is not null").select("rep", "bands")
    if not same.isEmpty():  # an id may be there with the same text again
        twice = one.join(same.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "bands"])
        one = one.join(same.select("rep").distinct(), "rep", "left_anti").unionByName(twice)
    comp = linked(docs, cut(one, "signatures"))
    named = member.join(comp, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("class"))
    least = cut(named.groupBy("doc_id").agg(F.min("class").alias("class_id"), F.max("class").alias("other")), "classes")
    ties = least.where("class_id <> other")
    if ties.isEmpty():
        return least.select("doc_id", "class_id")
    # an id with several texts joins their classes
    ids = named.join(ties.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    through = components(ids.unionByName(ids.join(least.select(F.col("doc_id").alias("a"), "class_id"), "a").select(F.col("class_id").alias("a"), "b")))
    return least.join(through, least["class_id"] == through["node"], "left").select("doc_id", F.coalesce("component", "class_id").alias("class_id"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least id (one of its rows, if it has several); rows without an id go."""
    named = cut(classes(docs), "classes")
    gone = named.where("doc_id <> class_id").select("doc_id")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.where("doc_id is not null").join(few, "doc_id", "left_anti").select(docs.columns)
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
