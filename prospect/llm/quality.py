"""Quality rules: plain counts, then bands on n-gram perplexity by language.

The model is an interpolated modified Kneser-Ney model of order 4 over
characters (lower case, white space and digits as one each). Spark counts the
n-grams of every text, each task adding up its own before they are shuffled, and
computes the probabilities by joins of the orders: nothing of it passes through
the driver but a few counts of counts. What is stored are sorted arrays of the
n-grams' hashes (a bijection, so none collide) with the log probabilities, looked
up by binary search. A text is not rated by what it alone contributed: an n-gram
that occurs once in all texts gets what the lower orders give it. The arrays grow
with the corpus; they are broadcast if they were counted to be ``MODEL_ROWS`` at
most (12 bytes each), beyond that the texts' n-grams are joined with the model.

Edge cases: a null or empty text has no words and fails the base rules; a very
long text is counted and rated whole; a null language is a language of its own;
languages with few texts share the band of all texts; repeated rows are counted
and returned as often as they come; an empty table gives no rows. Columns besides
``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, chunks, cut, encode, mix

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bits of a character and characters of an n-gram.
BITS, ORDER = 12, 4
MIN_WORDS = 50
#: A text fails when more than this share of its words stands in repeated 3-word windows.
MAX_REPEATED = 0.5
#: Half the width of a language's band in nats: LEAST_NATS, and SPREADS times the language's spread over the root of the
#: text's length in characters. LEAST_SPREAD is the least spread. A language's middle and spread count as much as its
#: number of texts, those of all texts as much as LENT texts.
LEAST_NATS, SPREADS, LEAST_SPREAD, LENT = 0.05, 4.0, 0.75, 20
#: Medians are exact to this step, so they do not depend on how rows are dealt and need a bounded histogram alone.
STEP = 1e-4
#: N-grams that may be broadcast (50 MB), and ids (8 MB).
MODEL_ROWS, BROADCAST_IDS = 1 << 22, 1 << 20


def _fold_table() -> np.ndarray:
    """Symbol of each code point: those below 2048 by themselves, others hashed to the upper half."""
    cp = np.arange(0x110000, dtype=np.uint64)
    half = 1 << (BITS - 1)
    out = np.where(cp < half, cp, half + ((cp * np.uint64(2654435761)) >> np.uint64(16)) % np.uint64(half)).astype(np.int64)
    out[[ord(c) for c in SPACES]], out[[ord(c) for c in "0123456789"]] = ord(" "), ord("0")
    return out


_FOLD: list[np.ndarray] = []


def ngrams(text: str) -> np.ndarray:
    """The n-gram that ends at each character of the text in lower case, as 48 bits; spaces stand before the text."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    s = np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _FOLD[0][s]
    n = len(s) - ORDER + 1
    out = s[:n].copy()
    for i in range(1, ORDER):
        out <<= BITS
        out |= s[i : n + i]
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per n-gram of the task."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for _, texts in chunks(batches):
        found = np.sort(np.concatenate([ngrams(t) for t in texts]))
        first = np.flatnonzero(np.diff(found, prepend=-1))
        keys, counts = _sums(np.concatenate([keys, found[first]]), np.concatenate([counts, np.diff(first, append=len(found))]))
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])


def _discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the numbers of n-grams with a count of 1 to 4."""
    n = [counts.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]


def train(docs: DataFrame) -> DataFrame:
    """(gram, logp): the log probability of each n-gram of the texts, by the lower orders alone if it occurs once."""
    counts = cut(docs.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "ngrams")
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        orders.append(cut(orders[-1].groupBy(F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "ngrams"))
    below = None
    for k, table in enumerate(reversed(orders), 1):
        times = table.groupBy(F.least("n", F.lit(5)).cast("int").alias("n")).agg(F.count(F.lit(1)).alias("c"))
        d = _discounts({r["n"]: r["c"] for r in times.collect()})  # five rows at most
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        of = Window.partitionBy(F.shiftright("gram", BITS))  # a context has 4,096 rows at most
        rows = table.withColumn("off", off).withColumn("total", F.sum("n").over(of)).withColumn("gamma", F.sum("off").over(of) / F.col("total"))
        if below is None:
            rows = rows.withColumn("q", F.lit(2.0**-BITS))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        back = F.col("gamma") * F.col("q")
        below = cut(rows.select("gram", "n", ((F.col("n") - F.col("off")) / F.col("total") + back).alias("p"), back.alias("back")), "order")
    return below.select("gram", F.log(F.when(F.col("n") > 1, F.col("p")).otherwise(F.col("back"))).cast("float").alias("logp"))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = encode(text).split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        marks = bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                marks[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(marks)
    return n, chars, n_symbols, len(lines) - len(set(lines)), repeated


class Arrays:
    """A model as arrays sorted by the n-grams' hashes."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        hashes = mix(gram.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.logp = hashes[order], logp[order]

    def nats(self, text: str) -> float | None:
        """Mean nats of a character; n-grams that no text of the model has get a uniform character."""
        if not text:
            return None
        grams, times = np.unique(ngrams(text), return_counts=True)
        if not len(self.hashes):
            return BITS * float(np.log(2))
        hashes = mix(grams.astype(np.uint64))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        logp = np.where(self.hashes[at] == hashes, self.logp[at], -BITS * np.log(2))
        return -float((times * logp).sum() / times.sum())


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _score(arrays):
    """Base counts, length and nats of each row; without arrays the n-grams instead of the nats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            out = [batch.column("doc_id"), batch.column("lang"), *(pa.array(counts[:, i]) for i in range(5)), pa.array([len(t) for t in texts], pa.int64())]
            if arrays is not None:
                out.append(pa.array([arrays.value.nats(t) for t in texts], pa.float64()))
            else:
                found = [np.unique(ngrams(t), return_counts=True) for t in texts]
                out += [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang", *_BASE, "n_chars", *(["nats"] if arrays is not None else ["grams", "times"])])

    return run


def measures(docs: DataFrame, model: DataFrame | None = None, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Per row: the base counts and the nats a character under the model (null for empty texts)."""
    docs = docs.select("doc_id", "text", "lang")
    model = cut(model if model is not None else train(docs), "model")
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, {', '.join(c + ' long' for c in _BASE)}, n_chars long"
    if model.count() <= model_rows:
        rows = model.toArrow()  # at most ``model_rows``
        arrays = docs.sparkSession.sparkContext.broadcast(Arrays(*(rows.column(c).to_numpy() for c in ("gram", "logp"))))
        return cut(docs.mapInArrow(_score(arrays), schema + ", nats double"), "quality")
    rows = cut(docs.mapInArrow(_score(None), schema + ", grams array<long>, times array<long>").withColumn("row", F.expr("uuid()")), "quality")
    each = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
    logp = F.coalesce(F.col("logp").cast("double"), F.lit(-BITS * float(np.log(2))))
    nats = each.join(model, "gram", "left").groupBy("row").agg((-F.sum(F.col("times") * logp) / F.sum("times")).alias("nats"))
    return rows.drop("grams", "times").join(nats, "row", "left").drop("row")


def _median(rows: DataFrame, value, name: str, step: float = STEP) -> DataFrame:
    """(of, name, n): each group's lower median, to a ``step``, and its number of rows."""
    each = rows.groupBy("of", F.round(value / step).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up, whole = Window.partitionBy("of").orderBy("v"), Window.partitionBy("of")
    each = each.withColumn("to", F.sum("c").over(up)).withColumn("all", F.sum("c").over(whole))
    return each.where(2 * F.col("to") >= F.col("all")).groupBy("of").agg((F.min("v") * step).alias(name), F.max("all").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it was counted to have ``BROADCAST_IDS`` rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def rate(docs: DataFrame, model: DataFrame | None = None, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``measures`` with ``base_failed``, the perplexity, its language's band and ``kept``.

    A band lies around its language's median of the mean nats, taken over the
    texts that pass the base rules. Means of short texts vary more, by the root
    of their length; so does the band. Its spread is the language's median of
    deviations times that root (1.4826 times it: a normal's deviation). Both are
    averaged with those of all texts: n texts of a language against ``LENT`` ones.
    """
    rows = measures(docs, model, model_rows).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words")))
    rows, root = cut(rows.withColumn("of", F.struct("lang")), "rated"), F.sqrt("n_chars")
    good = rows.where(~F.col("base_failed"))
    # a language by its name, all texts as null
    good = good.unionByName(good.withColumn("of", F.lit(None).cast(dict(rows.dtypes)["of"])))
    middle = cut(_median(good, F.col("nats"), "mid"), "middle")
    near = good.join(_small(middle).withColumnRenamed("of", "mid_of"), F.col("of").eqNullSafe(F.col("mid_of"))).drop("n")
    spread = _median(near, F.abs(F.col("nats") - F.col("mid")) * root, "mad", 10 * STEP)
    own = cut(middle.withColumnRenamed("of", "band").join(spread.drop("n"), F.col("band").eqNullSafe(F.col("of"))).select("band", "mid", "mad", "n"), "bands")
    every = own.where("band is null").first()
    lent = {c: F.lit(None if every is None else float(every[c])).cast("double") for c in ("mid", "mad")}
    n = F.coalesce("n", F.lit(0))
    mid, mad = ((n * F.coalesce(c, F.lit(0.0)) + LENT * lent[c]) / (n + LENT) for c in ("mid", "mad"))
    half = LEAST_NATS + SPREADS * F.greatest(1.4826 * F.col("mad"), F.lit(LEAST_SPREAD)) / F.greatest(root, F.lit(1.0))
    rated = rows.join(own.where("band is not null"), F.col("of") == F.col("band"), "left").withColumns({"mid": mid, "mad": mad})
    inside = F.coalesce(F.abs(F.col("nats") - F.col("mid")) <= half, F.lit(True))
    return rated.select(
        "doc_id", *_BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        "lang", F.exp("nats").alias("perplexity"), F.exp(F.col("mid") - half).alias("lower"), F.exp(F.col("mid") + half).alias("upper"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id has a row that passes; rows without an id go."""
    gone = cut(rate(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "gone")
    return docs.where("doc_id is not null").join(_small(gone), "doc_id", "left_anti").select(docs.columns)
