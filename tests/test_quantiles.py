"""Exact quantiles against sorting; lookups inside the row against joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.operators import features, quantiles


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, np.inf, np.nan])
    bits = quantiles.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [quantiles.value_of(int(b)) for b in bits[:-1]] == [*x[:4], 0.0, *x[5:-1]] and np.isnan(quantiles.value_of(int(bits[-1])))


@pytest.mark.parametrize("made", ["uniform", "ties", "wide", "one"])
def test_quantiles_equal_percentile(spark, made):
    r = random.Random(3)
    draw = {"uniform": r.random, "ties": lambda: float(r.randint(-3, 3)), "wide": lambda: r.choice((-1, 1)) * 10.0 ** r.randint(-300, 300), "one": lambda: 7.25}[made]
    rows = [(draw(),) for _ in range(1 if made == "one" else 3001)] + [(None,)]
    df = spark.createDataFrame(rows, "v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    expected = df.select(*[F.percentile("v", F.lit(s)).alias(f"s{i}") for i, s in enumerate(shares)]).first()
    assert quantiles.quantiles(df, "v", shares) == pytest.approx(list(expected), rel=1e-12)
    assert quantiles.quantiles(df.where("v IS NULL"), "v", [0.5]) == [None]


def test_lookups_inside_the_row_equal_joins(spark, monkeypatch):
    rows = [(1, ["a", "x", "b", "a"]), (2, []), (3, None), (4, ["x", None]), (None, ["b"])]
    texts = spark.createDataFrame(rows, "id long, tokens array<string>")
    words = spark.createDataFrame([("a", 5, [1.0, 2.0]), ("b", 6, [3.0, 4.0]), (None, 9, [0.0, 0.0])], "word string, id long, vector array<float>")

    def found():
        known = features.known_tokens(texts, ["id"], words)
        ids = features.vocabulary_ids(texts, ["id"], words.where("word IS NOT NULL"))
        return [sorted(map(tuple, df.collect()), key=repr) for df in (known.select("id", "tokens"), features.token_vectors(texts, ["id"], words), ids.select("id", "ids"))]

    inside = found()
    monkeypatch.setattr(features, "VOCABULARY_WORDS", 0)
    assert inside == found()
    assert inside[0][0] == (1, ["a", "b", "a"]) and inside[2][0] == (1, [5, -1, 6, 5]) and inside[1][0] == (1, [[1, 2], [3, 4], [1, 2]])
