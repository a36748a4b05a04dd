"""The neural ranker's gradient, what it learns beyond a linear scorer, and the boosted ranker on long lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.operators import metrics
from linkwell.plans import models, neural


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    s = neural.Settings(hidden=(5, 4))
    p, _ = neural.start(3, s)
    p = {n: v + rng.normal(scale=0.1, size=v.shape) for n, v in p.items()}
    x, group = rng.normal(size=(24, 3)), np.repeat(np.arange(4), 6)
    t = rng.integers(0, 3, 24).astype(float)
    for dropout in (0, 0.4):
        at = lambda q: neural.gradient(q, x, t, group, dropout, np.random.default_rng(9))  # noqa: B023, E731
        g, _, loss, pairs = at(p)
        assert pairs == sum((t[group == k][:, None] > t[group == k][None]).sum() for k in range(4)) and loss > 0
        for name in p:
            for i in np.ndindex(p[name].shape):
                ends = []
                for step in (1e-5, -1e-5):
                    q = {n: v.copy() for n, v in p.items()}
                    q[name][i] += step
                    ends.append(at(q)[2])
                assert g[name][i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=2e-3, abs=2e-4), (name, i)


def test_pair_loss_by_hand():
    loss, pull, pairs = neural.pair_loss(np.array([1.0, 0.0, 2.0, 5.0]), np.array([1.0, 0.0, 0.0, 1.0]), np.array([0, 0, 0, 1]))
    assert pairs == 2 and loss == pytest.approx(np.log1p(np.exp(-1)) + np.log1p(np.exp(1)))
    assert pull.sum() == pytest.approx(0) and pull[0] < 0 < pull[1] < pull[2] and pull[3] == 0


def ring(spark, groups=60, rows=20):
    """Better rows lie near a circle: no weighted sum of the features ranks them."""
    r = np.random.default_rng(5)
    data = [(g, float(x), float(y), int(abs(x * x + y * y - 1) < 0.45)) for g in range(groups) for x, y in r.normal(size=(rows, 2))]
    return spark.createDataFrame(data, "g int, x double, y double, t int")


def quality(scored):
    return metrics.ndcg(scored.withColumn("i", F.xxhash64("x", "y")), ["g"], "t", "score", "i", (5,)).agg(F.avg("ndcg")).first()[0]


def test_neural_and_boosted_rankers_beat_the_linear_one(spark, tmp_path):
    df = ring(spark)
    train, held = df.where("g < 45"), df.where("g >= 45")
    linear = quality(models.linear_score(held, models.pairwise_ranker(train, "g", ["x", "y"], "t")))
    s = neural.Settings(hidden=(16, 8), dropout=0.1, rate=0.3, steps=60, slices=2)
    net = neural.train(train, "g", ["x", "y"], "t", s)
    assert len(net.losses) == 60 and np.mean(net.losses[-6:]) < 0.8 * net.losses[0]
    assert quality(net.score(held)) > linear + 0.15
    net.save(str(tmp_path / "net"))
    again = neural.NeuralRanker.load(str(tmp_path / "net"))
    assert again.settings == s and quality(again.score(held)) == pytest.approx(quality(net.score(held)))
    trees = models.boosted_ranker(train, "g", ["x", "y"], "t", rounds=8, depth=4, rate=0.5)
    assert quality(trees.score(held)) > linear + 0.15
    odd = held.limit(2).withColumn("x", F.when(F.col("x") > 0, F.lit(None)).otherwise(F.lit(float("nan"))))
    assert all(np.isfinite(r.score) for r in net.score(odd).collect())


def test_a_long_list_teaches_the_boosted_ranker(spark):
    """More positives than a list holds: negatives still take part."""
    rows = [(1, i / 400, int(i >= 100)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x double, t int")
    scored = models.boosted_ranker(df, "g", ["x"], "t", rounds=4, depth=3, rate=0.5).score(df)
    got = scored.groupBy("t").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.countDistinct("score").alias("n")).collect()
    lo, hi = sorted(got, key=lambda r: r.t)
    assert lo.hi < hi.lo and lo.n + hi.n > 2


def test_groups_that_teach_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (2, 3.0, None)], "g int, x double, t int")
    net = neural.train(df, "g", ["x"], "t", neural.Settings(hidden=(2,), steps=2, slices=1))
    assert net.losses == () and net.score(df).count() == 3


def test_word_vectors_of_many_words_are_trained_in_parts(spark):
    r = np.random.default_rng(7)
    rows = [([f"t{t}w{i}" for i in r.integers(0, 8, 10)] + ["12.5"] * (j % 2),) for j, t in enumerate(r.integers(0, 5, 2000))]
    df = spark.createDataFrame(rows, "tokens array<string>")
    model = models.word_vectors(df, size=16, rounds=5, part_words=5000)
    assert model.getNumPartitions() == 5  # 21 000 words
    vectors = {x.word: x.vector.toArray() for x in model.getVectors().collect()}
    assert set(vectors) == {f"t{t}w{i}" for t in range(5) for i in range(8)} | {"<NUMBER>"}
    assert all(np.isfinite(v).all() and np.abs(v).max() > 0 for v in vectors.values())
    for t in range(5):
        assert sum(x.word.startswith(f"t{t}w") for x in model.findSynonyms(f"t{t}w0", 7).collect()) >= 6
    whole = models.word_vectors(df, size=16)
    plain = models.Word2Vec(vectorSize=16, seed=1, inputCol="tokens", outputCol="vector").fit(df.select(models.text.mask_numbers(F.col("tokens")).alias("tokens")))
    assert whole.getNumPartitions() == 1 and {x.word for x in whole.getVectors().collect()} == {x.word for x in plain.getVectors().collect()}
