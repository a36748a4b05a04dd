"""Subword embeddings: gradients' direction, neighbours, misspelt names, unseen words, edge cases; nearest vectors by blocks."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkwell.operators import subwords, vectors

SMALL = subwords.Settings(dim=24, window=3, epochs=8, rate=0.1, least=2, buckets=5000, sample=0, shard_words=4000, batch=32)
TOPICS = (
    ["melbourne", "brisbane", "canberra", "adelaide", "hobart", "darwin"],
    ["aspirin", "ibuprofen", "paracetamol", "amoxicillin", "naproxen", "codeine"],
    ["violin", "trumpet", "clarinet", "saxophone", "accordion", "harpsichord"])


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        topic = TOPICS[i % 3]
        one = rng.choice(topic)  # each word keeps company of its own besides its topic's
        own = [f"{'xyz'[i % 3]}{topic.index(one)}{c}" for c in "kqvwj"]
        words = [one, *rng.sample(own, 3), rng.choice(topic), rng.choice(("and", "with", "or"))]
        rng.shuffle(words)
        rows.append((words,))
    return subwords.fit(spark.createDataFrame(rows, "words array<string>").repartition(3), SMALL)


def ask(spark, model, *words, k=3):
    found = model.neighbours(spark.createDataFrame([(w,) for w in words], "word string"), k).collect()
    return {w: [r.word for r in sorted(found, key=lambda r: r["rank"]) if r.q == w] for w in words}


def test_neighbours_come_from_the_same_lists(spark, model):
    found = ask(spark, model, *(t[0] for t in TOPICS), k=10)
    for i, topic in enumerate(TOPICS):  # its own company and its topic
        near = found[topic[0]]
        assert len(near) == 10 and sum(w in topic or w.startswith(f"{'xyz'[i]}0") for w in near) >= 7, found


def test_misspelt_names_find_the_right_form(spark, model):
    forms = {"melborne": "melbourne", "ibuprofin": "ibuprofen", "saxaphone": "saxophone", "paracetemol": "paracetamol", "harpsicord": "harpsichord", "cannberra": "canberra"}
    found = ask(spark, model, *forms)
    assert sum(found[w][0] == right for w, right in forms.items()) >= 5, found


def test_vectors_of_unseen_words_are_means_of_their_known_parts(spark, model):
    word = "melborne"
    buckets = spark.range(1).select(subwords.grams(F.lit(word), SMALL)).first()[0]
    marked = f"<{word}>"
    cut = {marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)}
    assert len(cut) == 26 and sorted(buckets) == sorted({int(np.uint64(xxhash.xxh64_intdigest(g.encode(), 42)).astype(np.int64)) % SMALL.buckets for g in cut})
    held = {r.key: r.vector for r in model.parameters.where(F.col("kind") == subwords.GRAM).collect()}
    expected = np.mean([held[b] for b in buckets if b in held], 0)
    got = {r.word: r.vector for r in model.vectors(spark.createDataFrame([(word,), (word,), (None,), ("日",)], "word string")).collect()}
    assert list(got) == [word] and np.allclose(got[word], expected, atol=1e-6)


def test_saved_model_answers_alike(spark, model, tmp_path):
    model.save(str(tmp_path))
    again = subwords.Model.load(spark, str(tmp_path))
    assert again.settings == SMALL and ask(spark, again, "melborne") == ask(spark, model, "melborne")


def test_odd_rows(spark):
    rows = [(None,), ([],), ([None, "ab"],), (["ab", "rare"],), (["word", "ab"] * 1500,)]
    found = subwords.fit(spark.createDataFrame(rows, "words array<string>"), subwords.replace(SMALL, epochs=1))
    assert {(r.word, r.n) for r in found.vocabulary.collect()} == {("ab", 1502), ("word", 1500)}
    assert {r.word for r in found.vectors(found.vocabulary).collect()} == {"ab", "word"}
    with pytest.raises(ValueError):
        subwords.fit(spark.createDataFrame([(["once"],)], "words array<string>"), SMALL)


def test_a_shard_lowers_its_loss():
    """The sampled loss of a shard falls, and words that stand together get outputs that agree."""
    rng = np.random.default_rng(1)
    s = subwords.replace(SMALL, dim=8)
    sentences = [rng.choice(np.arange(0, 4) if i % 2 else np.arange(4, 8), 6) for i in range(400)]
    parts = np.array([[i, 8 + i % 3] for i in range(8)])
    inputs, outputs = subwords._start(np.arange(12), 8, 1), np.zeros((8, 8))
    inputs[-1] = 0
    for _ in range(3):
        subwords.train_shard(sentences, np.full(8, 300.0), parts, np.full(8, 2), inputs, outputs, s, 0.1, rng, 2400.0)
    score = (inputs[parts].sum(1) / 2) @ outputs.T
    same = np.equal.outer(np.arange(8) < 4, np.arange(8) < 4)
    assert score[same].mean() > 1 + score[~same].mean() and not inputs[-1].any()


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).round(1)
    x[7] = 0
    x[20:25] = x[20]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), np.nan)
    cos = np.round(unit @ unit.T, 6)
    for most in (10_000, 9):
        got = {(r.q, r["rank"]): (r.vec_id, r.cosine) for r in vectors.nearest(df.where("vec_id % 10 = 0"), df, 5, most=most).collect()}
        assert len(got) == 30 * 5
        for q in range(0, 300, 10):
            order = sorted((i for i in range(300) if i != q), key=lambda i: (np.isnan(cos[q, i]), -np.nan_to_num(cos[q, i]), i))[:5]
            assert [got[q, k + 1][0] for k in range(5)] == order
    assert vectors.nearest(df.limit(0), df, 3).count() == 0
