"""Word vectors trained through a classifier: its gradient, and pairs whose words decide."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.plans import models, wordnet


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    s = wordnet.Settings(dim=2, hidden=(4, 3))
    layers = [(w, c + rng.normal(scale=0.3, size=c.shape)) for w, c in wordnet.first_layers(s)]  # no unit sits at its kink
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    for dropout in (0, 0.3):
        at = lambda l, x: wordnet.gradient(l, x, y, dropout, np.random.default_rng(5))  # noqa: B023, E731, E741
        sums, back, loss = at(layers, x)
        flat = [g for pair in layers for g in pair]
        for k, g in enumerate(flat):
            for i in np.ndindex(g.shape):
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [v.copy() for v in flat]
                    moved[k][i] += step
                    ends.append(at(list(zip(moved[::2], moved[1::2], strict=True)), x)[2])
                assert sums[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)
        for i in np.ndindex(x.shape):
            ends = [at(layers, x + step * (np.arange(x.size).reshape(x.shape) == i[0] * 4 + i[1]))[2] for step in (1e-6, -1e-6)]
            assert back[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)


def test_trained_through_vectors_beat_fixed_ones(spark):
    """Words belong to hidden kinds, which their fixed vectors do not tell; a pair matches if the kinds of its deciding words agree."""
    rng = random.Random(2)
    kind = {f"{side}{i}": i % 2 for side in "qd" for i in range(60)}
    rows = []
    for i in range(2400):
        a, b = rng.randrange(60), rng.randrange(60)
        filler = [f"f{rng.randrange(15)}" for _ in range(2)]
        rows.append((i, [f"q{a}", *filler], [filler[0], f"d{b}"], int(kind[f"q{a}"] == kind[f"d{b}"])))
    rows.append((10**6, None, [], None))
    df = spark.createDataFrame(rows, "i long, q_terms array<string>, d_terms array<string>, y int")
    learn, held = df.where("i < 1800"), df.where("i >= 1800")
    accuracy = lambda scored: scored.where("y IS NOT NULL").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    s = wordnet.Settings(dim=8, hidden=(24,), dropout=0.1, rate=0.3, steps=36, slices=2, part_rows=300)
    model = wordnet.train(learn, "y", s)
    mine = accuracy(model.score(held, out="p"))
    assert len(model.losses) == 36 and model.losses[-1] < 0.5 * model.losses[0]
    assert model.score(held).where("i = 1000000").first().prob is not None

    fixed = np.random.default_rng(3).normal(size=(200, 8))
    words = {w: fixed[k].tolist() for k, w in enumerate([*kind, *(f"f{i}" for i in range(15))])}
    mean = F.udf(lambda x: [float(v) for v in np.mean([words[w] for w in x], 0)] if x else None, "array<double>")
    with_means = df.where("y IS NOT NULL").select("i", "y", mean("q_terms").alias("q_mean"), mean("d_terms").alias("d_mean"))
    other = models.embedding_classifier(with_means.where("i < 1800"), "y", 8, hidden=(24,), rounds=60)
    theirs = accuracy(other.transform(models.embedding_inputs(with_means.where("i >= 1800"), 8)).withColumn("p", F.col("prediction")))
    assert mine > 0.9 and mine > theirs + 0.05, (mine, theirs)
