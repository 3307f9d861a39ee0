"""Restricted refinement against all conjunctions."""

import itertools
import random

import numpy as np
import pytest

from prospect.functions.predicates import Truth, attributes
from prospect.operators import closed, language


@pytest.mark.parametrize("seed, flags, rows", [(1, 6, 90), (2, 5, 400), (3, 7, 25)])
def test_each_closed_set_once_with_its_support(spark, seed, flags, rows):
    rng = random.Random(seed)
    held = np.array([[rng.random() < (0.3, 0.6, 0.9)[j % 3] for j in range(flags)] for _ in range(rows)])
    held[:, 1] |= held[:, 0]  # one holds wherever another does
    df = spark.createDataFrame([tuple(map(bool, r)) for r in held], ", ".join(f"f{j} boolean" for j in range(flags)))
    table = language.compress(df, [Truth(a) for a in attributes(df)], {})
    want = {}
    for d in range(flags + 1):
        for c in itertools.combinations(range(flags), d):
            m = held[:, list(c)].all(axis=1)
            if m.any():
                want[tuple(np.flatnonzero(held[m].all(axis=0)).tolist())] = int(m.sum())
    got = [(tuple(r["items"]), r["n"]) for r in closed.restricted(table, flags).collect()]
    assert len(got) == len(want) and dict(got) == want
    some = closed.restricted(table, flags, least=rows // 3).collect()
    assert {tuple(r["items"]): r["n"] for r in some} == {c: n for c, n in want.items() if n >= rows // 3}


def test_more_predicates_than_a_word_has_bits(spark):
    wide = 130
    sets = [[0, 61, 62, 129], [0, 61, 62], [61, 62, 124], [0, 129], [0, 61, 62, 129]]
    words = [[language.mask(s, wide), 2] for s in sets]
    table = spark.createDataFrame(words, "words array<long>, n long").groupBy("words").sum("n").withColumnRenamed("sum(n)", "n")
    got = {tuple(r["items"]): r["n"] for r in closed.restricted(table, wide).collect()}
    want = {}
    for k in range(1, 6):
        for some in itertools.combinations(range(5), k):
            common = tuple(sorted(set.intersection(*(set(sets[i]) for i in some))))
            want[common] = 2 * sum(set(common) <= set(s) for s in sets)
    assert got == want


def test_no_rows(spark):
    assert closed.restricted(spark.createDataFrame([], "words array<long>, n long"), 3).collect() == []
