"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut at every 1024th: full pieces are sequences by
themselves, the rest (1 to 1023 ids) is an item to pack. Sizes are rounded up to
units of 8 ids for planning, so the problem is a histogram of 128 sizes,
whatever the size of the corpus. Its linear program (patterns of sizes that fill
a sequence, every size covered, fewest sequences) is solved by column
generation: a simplex step for the duals, a knapsack by dynamic programming that
prices the best new pattern. Rounded down, the patterns say how many sequences
of each kind there are; the few items left over are packed by first fit
decreasing, and the plan remains of bounded size. Documents are ranked within
their size, without shuffling them: each task numbers its own, sums of its
counts give the task's first number, and rank and plan give the sequence and the
place in it. Within a sequence the pieces then close up without gaps.

Where the tokens are made, ids come from the given tokenizer file. The same
vocabulary as ranks, if its path is given, takes over texts in which it must
give the same ids (those without a special token's string), being six times as
fast; the tests compare the two.

Edge cases: a null or empty text is the end-of-document id alone; repeated rows
are packed as often as they come; an empty table gives no pieces. Columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, cut

LENGTH, END, UNIT = 1024, 0, 8
BPE, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids of texts by a tokenizer file, and by the same vocabulary's ranks where that is sure to be equal."""

    def __init__(self, path: str | None, ranks: str | None = None):
        self.path, self.tokenizer, self.fast = path, None, self._ranks(ranks) if ranks else None
        self.special = [t["content"] for t in json.loads(open(path, encoding="utf-8").read()).get("added_tokens", [])] if path else []

    def slow(self, text: str) -> list[int]:
        if self.tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @classmethod
    def of_ranks(cls, ranks: str) -> Encoder:
        """Ids by the ranks alone: a special token's string is ordinary text."""
        return cls(None, ranks)

    @staticmethod
    def _ranks(path: str):
        with open(path, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> list[int]:
        text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
        if self.fast is None or any(s in text for s in self.special):
            return self.slow(text)
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def _cut_up(path: str, ranks: str | None, length: int, end: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, ranks), TaskContext.get().partitionId()
        seen = np.zeros(length // UNIT + 2, np.int64)  # pieces of each size so far, which number the next ones
        for batch, texts in chunks(batches):
            row, start, size, kind, rank, total, out = [], [], [], [], [], [], []
            for i, text in enumerate(texts):
                ids = np.array(enc.ids(text) + [end], "<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length].tobytes()
                    n = len(piece) // 4
                    k = 0 if n == length else -(-n // UNIT)
                    row.append(i), start.append(at), size.append(n), kind.append(k), rank.append(seen[k]), total.append(len(ids))
                    out.append(zlib.crc32(piece) if digest else piece)
                    seen[k] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size)), pa.array(out, pa.int64() if digest else pa.binary()), *(pa.array(x, pa.int64()) for x in (total, kind, rank)), pa.array([part] * len(row), pa.int64())],
                ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "units", "rank", "part"],
            )

    return run


def pieces(docs: DataFrame, path: str | None = None, ranks: str | None = None, length: int = LENGTH, end: int = END, digest: bool = False) -> DataFrame:
    """Pieces of up to ``length`` ids, written once: their ids (unsigned 32-bit, little-endian) or those ids' CRC-32.

    ``units`` is the rounded size (0: a full piece); ``part`` and ``rank`` number the pieces of one: rank counts within the part.
    """
    if path is None:
        path, ranks = public_tokenizers.path(BPE), public_tokenizers.path(RANKS)
    docs = docs.select("doc_id", "text")
    out = "ids_crc32 long" if digest else "ids binary"
    return cut(docs.mapInArrow(_cut_up(path, ranks, length, end, digest), f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, {out}, doc_tokens long, units long, rank long, part long"), "pieces")


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack: the multiset of sizes within the capacity of most value."""
    worth = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    by_size = np.zeros(capacity + 1)
    at = np.full(capacity + 1, -1)
    by_size[sizes], at[sizes] = values, np.arange(len(sizes))
    for c in range(1, capacity + 1):
        gain = by_size[1 : c + 1] + worth[c - 1 :: -1]
        best = int(np.argmax(gain))
        if gain[best] > worth[c - 1] + 1e-15 and at[best + 1] >= 0:
            worth[c], took[c] = gain[best], best + 1
        else:
            worth[c], took[c] = worth[c - 1], 0
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] == 0:
            c -= 1
        else:
            pattern[at[took[c]]] += 1
            c -= took[c]
    return float(worth[capacity]), pattern


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination of the small basis, without a threaded library."""
    m = len(basis)
    both = np.concatenate([basis, np.eye(m)], axis=1)
    for i in range(m):
        at = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0.0
        both -= np.outer(factor, both[i])
    return both[:, m:]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int = LENGTH // UNIT, gap: float = 0.001, rounds: int = 3000) -> tuple[list[np.ndarray], np.ndarray]:
    """The linear program's basis and its (fractional) uses, by the revised simplex method.

    Each round prices a pattern by the knapsack; none better, or a dual bound
    within ``gap``, ends it.
    """
    m = len(sizes)
    cols = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    bound = 0.0
    for turn in range(rounds):
        if turn % 200 == 199:
            inverse = _inverse(np.array(cols, float).T)
            x = inverse @ demand
        dual = inverse.sum(axis=0)
        value, pattern = _best_pattern(sizes, np.maximum(dual, 0), capacity)
        bound = max(bound, float(dual @ demand) / max(value, 1.0))  # Farley's bound
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        step = inverse @ pattern
        ratio = np.divide(x, step, out=np.full(m, np.inf), where=step > 1e-10)
        out = int(np.argmin(ratio))
        theta = max(0.0, ratio[out])
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        cols[out] = pattern
    return cols, x


def plan(counts: dict[int, int], capacity: int = LENGTH // UNIT) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (units, first, last, each, sequence, slot) that place the items of each size.

    Items of the size ranked first to last - 1 go to sequences from
    ``sequence`` on, ``each`` to a sequence, in its slots from ``slot`` on.
    """
    sizes = np.array(sorted(counts), np.int64)
    if not len(sizes):
        return []
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    cols, x = patterns(sizes, left.astype(float), capacity)
    uses: list[tuple[np.ndarray, int]] = []
    for col, times in sorted(zip(cols, np.floor(x + 1e-9).astype(np.int64)), key=lambda p: -p[1]):
        fits = min([int(times), *(int(left[i] // col[i]) for i in np.flatnonzero(col))])
        if fits > 0:
            left = left - fits * col
            uses.append((col, fits))
    # first fit decreasing for what rounding left: at most a sequence for each pattern
    bins: list[tuple[np.ndarray, list[int]]] = []
    for i in reversed(range(len(sizes))):
        for _ in range(int(left[i])):
            for col, room in bins:
                if room[0] >= sizes[i]:
                    break
            else:
                col, room = np.zeros(len(sizes), np.int64), [capacity]
                bins.append((col, room))
            col[i] += 1
            room[0] -= int(sizes[i])
    uses += [(col, 1) for col, _ in bins]
    rows, first, sequence = [], np.zeros(len(sizes), np.int64), 0
    for col, many in uses:
        slot = 0
        for i in np.flatnonzero(col):
            each = int(col[i])
            rows.append((int(sizes[i]), int(first[i]), int(first[i]) + each * many, each, sequence, slot))
            first[i] += each * many
            slot += each
        sequence += many
    return rows


def assign(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``; a sequence of one full piece has a number from 2**40 on."""
    spark = found.sparkSession
    names = [c for c in found.columns if c not in ("units", "rank", "part")] + ["sequence_id", "offset"]
    whole = found.where("units = 0").withColumn("sequence_id", F.lit(1 << 40) + F.col("part") * F.lit(1 << 36) + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    open_ = found.where("units > 0")
    by_part = cut(open_.groupBy("units", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_part.select("units", "part", before.alias("before"))
    counts = {r["units"]: r["n"] for r in by_part.groupBy("units").agg(F.sum("n").alias("n")).collect()}  # a row for each of the 128 sizes
    by_size: dict[int, list] = {}
    for units, *run in plan(counts, length // UNIT):
        by_size.setdefault(units, []).append(tuple(run))
    # a row for each size, with its runs by rank: bounded by the sizes and the patterns
    runs = spark.createDataFrame([(u, [r[0] for r in rs], rs) for u, rs in by_size.items()], "of long, firsts array<long>, runs array<struct<first:long,last:long,each:long,sequence:long,slot:long>>")
    rest = open_.join(first, ["units", "part"]).withColumn("at", F.col("rank") + F.col("before")).join(F.broadcast(runs), F.col("units") == F.col("of"))
    rest = rest.withColumn("run", F.get("runs", F.expr("size(filter(firsts, f -> f <= at)) - 1"))).withColumn("k", F.col("at") - F.col("run.first"))
    rest = rest.withColumn("sequence_id", F.col("run.sequence") + F.floor(F.col("k") / F.col("run.each")).cast("long")).withColumn("slot", F.col("run.slot") + F.col("k") % F.col("run.each"))
    # a sequence has at most its length of pieces
    gapless = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("offset", F.coalesce(gapless, F.lit(0)))
    return whole.select(names).unionByName(rest.select(names))


def pack(docs: DataFrame, digest: bool = False, **how) -> DataFrame:
    """The pieces of ``docs``, with ids (or their CRC-32), sequence and offset."""
    return assign(pieces(docs, digest=digest, **how), how.get("length", LENGTH))
