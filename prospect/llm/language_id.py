"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the learning part knows counts with its log frequency in each language.
One that it doesn't know counts by its longest character n-grams (five characters,
the ends marked) of which any is known: with the mean of their log frequencies among
n-grams of that length; if none is, by those one shorter, down to single characters.
A text's language is that with the largest sum over all its words, its score what
that language has of the sum of all likelihoods.

Words and n-grams are counted by Spark in all learning texts, as often as they come.
Known is what makes a share of at least ``L / WORDS`` (n-grams: ``L / GRAMS``) of its
language's, with L languages: so there are at most ``WORDS`` known pairs of word and
language, and ``GRAMS`` of each length, however large the corpus, and that much is
broadcast, as sorted arrays of hashes. What is rarer in a language counts with that
least share there, and is left to shorter n-grams if it is as rare in all.

Edge cases: a null text and one without a letter are ``und`` with a score of 0, and so
is any where no language was learned; letters of which nothing is known, and
ties, go to the language with more words learned, then to the first name; of a run of
more than ``RUN`` letters each ``RUN`` are a word, very long texts are read whole; a null id is never
learned from and counts as held out; repeated rows come, and are learned from, as
often as they come; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, cut, encode, shingles

WORDS, GRAMS, LONGEST, RUN, FOLDS, HELD = 1 << 20, 1 << 18, 5, 64, 3, 1
#: Entries that a task counts before it passes the counts on, at about this many at most beyond.
HELD_ENTRIES = 1 << 18
#: Words whose n-grams a task counts at a time, and whose scores it keeps, at least.
STEP, CACHED = 1 << 16, 1 << 17
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{RUN - 1}}}")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(found: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, the ends of words marked by spaces, and the number of the word that each is of.

    A single character is never a space.
    """
    points = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.cumsum(points == 32) - 1
    hashes = shingles(points, size)
    starts = of[: len(hashes)]
    # between its ends an n-gram has no space
    whole = points != 32 if size == 1 else of[size - 2 : size - 2 + len(hashes)] == starts
    return hashes[whole], starts[whole]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(True))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: dict[str, Counter] = {}

    def passed_on():
        for lang, counts in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        tally.clear()

    for batch, texts in chunks(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            tally.setdefault(lang, Counter()).update(words(text))
        if sum(map(len, tally.values())) >= HELD_ENTRIES:
            yield from passed_on()
    yield from passed_on()


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            for start in range(0, own.num_rows, STEP):
                part = own.slice(start, STEP)
                found, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                for size in range(1, LONGEST + 1):
                    hashes, of = grams(found, size)
                    keys, at = np.unique(hashes, return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, at, n[of])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "size", "gram", "n"])


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) and (lang, size, gram, n) of all rows of (lang, text)."""
    of_words = docs.mapInArrow(_words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    of_words = cut(of_words, "words")
    of_grams = of_words.mapInArrow(_grams_of, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return of_words, cut(of_grams, "grams")


@dataclass
class Table:
    """Log frequencies of what is known: sorted hashes, each with the entries of its languages."""

    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    log: np.ndarray
    least: float

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def sums(self, at: np.ndarray, of: np.ndarray, out: np.ndarray) -> None:
        """Add the log frequencies of the places ``at`` to the rows ``of``; unknown ones and languages have the least."""
        out += np.bincount(of, minlength=len(out))[:, None] * self.least
        at, of = at[at >= 0], of[at >= 0]
        n = self.starts[at + 1] - self.starts[at]
        first = np.repeat(self.starts[at] - np.cumsum(n) + n, n)
        entries = first + np.arange(len(first))
        np.add.at(out, (np.repeat(of, n), self.lang[entries]), self.log[entries] - self.least)


@dataclass
class Model:
    langs: list[str]
    known: Table
    parts: dict[int, Table]

    def score(self, found: list[str], hashes: WordHashes) -> np.ndarray:
        """What each word says for each language: its log frequency, or the mean of those of its longest n-grams of which any is known."""
        out = np.zeros((len(found), len(self.langs)))
        at = self.known.find(hashes.of(list(map(encode, found))))
        own = np.flatnonzero(at >= 0)
        part = np.zeros((len(own), len(self.langs)))
        self.known.sums(at[own], np.arange(len(own)), part)
        out[own] = part
        left = np.flatnonzero(at < 0)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, of = grams([found[i] for i in left], size)
            at = self.parts[size].find(keys)
            known = np.bincount(of[at >= 0], minlength=len(left)) > 0
            part = np.zeros((len(left), len(self.langs)))
            self.parts[size].sums(at[known[of]], of[known[of]], part)
            out[left[known]] = part[known] / np.bincount(of, minlength=len(left))[known, None]
            left = left[~known]
        return out


def _table(keys: np.ndarray, found: pa.Table, room: int, langs: list[str]) -> Table:
    numbers = {x: i for i, x in enumerate(langs)}
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    lang = np.fromiter((numbers[x] for x in found.column("lang").to_pylist()), np.int32, len(found))[order]
    return Table(keys, np.append(starts, len(found)), lang, np.log(found.column("share").to_numpy())[order].astype(np.float32), float(np.log(1 / room)))


def train(docs: DataFrame, most_words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """The model of all rows of (lang, text): at most ``most_words`` and five times ``most_grams`` entries reach the driver."""
    of_words, of_grams = counts(docs)
    langs = [r["lang"] for r in of_words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").select("lang").toLocalIterator()]

    def known(of, most, by):
        room = max(1, most // max(1, len(langs)))
        totals = of.groupBy(*by).agg(F.sum("n").alias("total"))  # a row a language and length
        shares = of.join(F.broadcast(totals), by).withColumn("share", F.col("n") / F.col("total"))
        return shares.where(F.col("share") * room >= 1).drop("n", "total").toArrow(), room

    found, room = known(of_words, most_words, ["lang"])
    own = _table(WordHashes().of(list(map(encode, found.column("word").to_pylist()))), found, room, langs)
    found, room = known(of_grams, most_grams, ["lang", "size"])
    parts = {}
    for size in range(1, LONGEST + 1):
        part = found.filter(pc.equal(found.column("size"), size))
        parts[size] = _table(part.column("gram").to_numpy().view(np.uint64), part, room, langs)
    return Model(langs, own, parts)


class _Numbers(dict):
    """Numbers for words, given as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        hashes, numbers, rows = WordHashes(), _Numbers(), np.zeros((0, len(m.langs)))
        for batch, texts in chunks(batches):
            if len(numbers) > CACHED:
                numbers, rows = _Numbers(), np.zeros((0, len(m.langs)))
            own = [words(t) if m.langs else [] for t in texts]
            at = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in own]
            new = list(islice(numbers, len(rows), None))
            if new:
                rows = np.concatenate([rows, m.score(new, hashes)])
            langs, scores = [], []
            for i in at:
                if not len(i):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                sums = rows[i].sum(axis=0)
                best = int(np.argmax(sums))
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(sums - sums[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def rate(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows with a language that are not held out."""
    learned = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    return predict(docs, train(learned)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
