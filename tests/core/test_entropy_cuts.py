"""Cuts of greatest entropy against all choices."""

import itertools
import math
import random
from collections import Counter

import pytest

from prospect.functions import discretise
from prospect.functions.discretise import Entropy, Frequency
from prospect.functions.predicates import Prediciser, attributes


def best(values, count):
    n, counts = len(values), Counter(values)
    distinct = sorted(counts)

    def entropy(cuts):
        sizes = [sum(c for v, c in counts.items() if (a is None or v >= a) and (b is None or v < b)) for a, b in zip([None, *cuts], [*cuts, None])]
        return -sum(s / n * math.log(s / n) for s in sizes)

    return max(entropy(c) for c in itertools.combinations(distinct[1:], min(count, len(distinct) - 1))), entropy


@pytest.mark.parametrize("count", [1, 2, 3, 6])
def test_entropy_cuts_against_all_choices(spark, count):
    rng = random.Random(count)
    rows = [(min(int(rng.expovariate(0.4)), 9) * 1.0, rng.choice([0.0, 0.0, 0.0, 0.0, 1.0, 2.5, 7.0]), rng.gauss(0, 1), 3.0, None if i else float("nan")) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    cuts = Entropy(count).cuts(df, ["a", "b", "d", "e"])
    for j, name in ((0, "a"), (1, "b")):
        top, of = best([r[j] for r in rows], count)
        assert len(cuts[name]) == min(count, len({r[j] for r in rows}) - 1) and abs(of(cuts[name]) - top) < 1e-12
    assert cuts["d"] == cuts["e"] == [] and Entropy(count).cuts(df, []) == {}


def test_entropy_cuts_beat_quantiles_under_ties(spark):
    values = [0.0] * 50 + [1.0] * 10 + [2.0] * 10 + [3.0] * 10 + [4.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    _, of = best(values, 2)
    assert of(Entropy(2).cuts(df, ["x"])["x"]) > of(Frequency(2).cuts(df, ["x"])["x"])
    assert len(Prediciser(Entropy(2)).predicates(df, attributes(df))) > 0


def test_entropy_cuts_of_many_values(spark, monkeypatch):
    """With fewer places than values the bins are as even as places allow; the same rule at any size."""
    monkeypatch.setattr(discretise, "PLACES", 16)
    df = spark.range(1000).selectExpr("cast(id as double) as x")
    cuts = Entropy(3).cuts(df, ["x"])["x"]
    assert [round(c / 1000, 1) for c in cuts] == [0.2, 0.5, 0.8] or all(abs(c / 1000 - q) <= 1 / 16 for c, q in zip(cuts, (0.25, 0.5, 0.75)))
