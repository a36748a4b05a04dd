"""Word embeddings that know the parts of words: skip-gram with negative sampling over hashed character n-grams.

A word's vector is the mean of its own and of its n-grams' vectors, so words that training never saw, misspelt
names above all, have vectors too.

Sentences are dealt into shards of bounded size.  In each epoch a shard meets only the parameters that its words
use, trains on them by itself, and returns them with their weights; the average by parameter, which is summed
map-side first, makes the next epoch's table.  No task, and not the driver, holds the whole table; epochs are
written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.functions.text import chunks
from linkwell.operators.vectors import nearest
from linkwell.storage import discard, materialize

#: Kinds of parameters: a word's own vector, an n-gram's, and a word's as a neighbour.
WORD, GRAM, CONTEXT = 0, 1, 2
#: Words of a sentence that are trained together; longer ones are cut.
LONGEST_SENTENCE = 1000
PARAMETERS = "kind int, key long, vector array<float>, weight double"


@dataclass(frozen=True)
class Settings:
    dim: int = 100
    window: int = 5
    negatives: int = 5
    epochs: int = 5
    rate: float = 0.05
    least: int = 5  # occurrences of a word
    shortest: int = 3  # letters of an n-gram, word ends counted
    longest: int = 6
    buckets: int = 2_000_000
    sample: float = 1e-3  # share from which frequent words are thinned out; 0: none
    shard_words: int = 100_000
    batch: int = 64
    seed: int = 1


@dataclass(frozen=True)
class Model:
    settings: Settings
    vocabulary: DataFrame  # word, n
    parameters: DataFrame  # kind, key, vector

    def vectors(self, words: DataFrame) -> DataFrame:
        """(word, vector) of the distinct words of (word): the mean of what training knows of each, its n-grams and itself.

        Null words and words of which it knows nothing have no row.
        """
        asked = words.where("word IS NOT NULL").select("word").distinct()
        parts = asked.select("word", F.explode(grams(F.col("word"), self.settings)).alias("key")).withColumn("kind", F.lit(GRAM))
        parts = parts.unionByName(asked.select("word", F.xxhash64("word").alias("key"), F.lit(WORD).alias("kind")))
        return _mean(parts.join(self.parameters, ["kind", "key"]).withColumn("weight", F.lit(1.0)), ["word"], self.settings.dim).select("word", "vector")

    def neighbours(self, words: DataFrame, k: int = 10) -> DataFrame:
        """(q, rank, word, cosine): the vocabulary's words nearest to each word of (word), itself excluded."""
        asked = materialize(self.vectors(words), "subword-asked")
        return nearest(asked, materialize(self.vectors(self.vocabulary), "subword-known"), k, "word", "vector")

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.parameters.write.mode("overwrite").parquet(f"{path}/parameters")
        self.vocabulary.sparkSession.createDataFrame([tuple(vars(self.settings).values())], list(vars(self.settings))).coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        held = spark.read.json(f"{path}/settings").first().asDict()
        return cls(replace(Settings(), **held), spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/parameters"))


def grams(word: Column, s: Settings) -> Column:
    """The distinct buckets of a word's n-grams, its ends marked; the whole word is none of them."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    size = F.length(marked)

    def of_length(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
        return F.when(size > n, cut).otherwise(F.array().cast("array<string>"))

    cut = [of_length(n) for n in range(s.shortest, s.longest + 1)]
    return F.array_distinct(F.transform(F.flatten(F.array(*cut)), lambda g: F.pmod(F.xxhash64(g), F.lit(s.buckets))))


def _mean(rows: DataFrame, by: list[str], dim: int) -> DataFrame:
    """The weighted mean vector of each key; sums are partial before the shuffle."""
    sums = [F.sum(F.get("vector", F.lit(i)) * F.col("weight")).alias(f"_{i}") for i in range(dim)]
    summed = rows.groupBy(*by).agg(F.sum("weight").alias("_w"), *sums)
    return summed.select(*by, F.array(*[(F.col(f"_{i}") / F.col("_w")).cast("float") for i in range(dim)]).alias("vector"))


def _start(keys: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Small vectors that depend on the key alone, so that all shards begin alike."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1 + seed * dim, 1 + (seed + 1) * dim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5) / dim


def _windows(ids: np.ndarray, ends: np.ndarray, window: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and neighbours: each centre draws its own width."""
    sentence = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    width, centre, other = rng.integers(1, window + 1, len(ids)), [], []
    for o in range(1, window + 1):
        i = np.arange(len(ids) - o)
        i = i[sentence[i] == sentence[i + o]]
        left, right = i[width[i] >= o], i[width[i + o] >= o]
        centre += [ids[left], ids[right + o]]
        other += [ids[left + o], ids[right]]
    return np.concatenate(centre), np.concatenate(other)


def train_shard(sentences: list[np.ndarray], counts: np.ndarray, parts: np.ndarray, known: np.ndarray, inputs: np.ndarray, outputs: np.ndarray, s: Settings, rate: float, rng: np.random.Generator, total: float) -> None:
    """One pass over a shard, in place.

    ``counts``: how often the vocabulary has each word; ``parts``: rows of ``inputs`` of each word, filled up with the last row, which is none;
    ``known``: how many of them there are; ``total``: words of the corpus.
    """
    if s.sample:
        share = s.sample * total / counts
        kept = np.minimum(1, np.sqrt(share) + share)
        sentences = [x[rng.random(len(x)) < kept[x]] for x in sentences]
    ids = np.concatenate(sentences) if sentences else np.zeros(0, np.int64)
    if len(ids) < 2:
        return
    centre, other = _windows(ids, np.cumsum([len(x) for x in sentences]), s.window, rng)
    order = rng.permutation(len(centre))
    centre, other = centre[order], other[order]
    odds = np.cumsum(counts**0.75)
    label = np.zeros(1 + s.negatives)
    label[0] = 1
    for a in range(0, len(centre), s.batch):
        c, o = centre[a : a + s.batch], other[a : a + s.batch]
        step = rate * (1 - a / len(centre) * 0.5)
        drawn = np.searchsorted(odds, rng.random((len(c), s.negatives)) * odds[-1])
        at = np.concatenate([o[:, None], np.minimum(drawn, len(counts) - 1)], 1)
        rows = parts[c]
        hidden = inputs[rows].sum(1) / known[c][:, None]
        weights = outputs[at]
        gap = label - 1 / (1 + np.exp(-np.clip((weights * hidden[:, None, :]).sum(2), -30, 30)))
        gap[:, 1:][at[:, 1:] == o[:, None]] = 0
        gap *= step
        pull = (gap[:, :, None] * weights).sum(1)
        np.add.at(outputs, at, gap[:, :, None] * hidden[:, None, :])
        # a row's pull is summed by word before it is spread over the word's parts
        words, inverse = np.unique(c, return_inverse=True)
        sums = np.zeros((len(words), s.dim))
        np.add.at(sums, inverse, pull)
        np.add.at(inputs, parts[words].ravel(), np.repeat(sums, parts.shape[1], 0))
        inputs[-1] = 0


def _epoch(s: Settings, epoch: int, total: float):
    rate = s.rate * (1 - epoch / s.epochs)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.filter(pa.compute.is_valid(right["word"]))
        held = right.filter(pa.compute.is_null(right["word"]))
        names = words["word"].to_pylist()
        if not names or not len(left):
            return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float32())), "weight": pa.array([], pa.float64())})
        place = {w: i for i, w in enumerate(names)}
        word_keys = words["key"].to_numpy()
        gram_lists = words["grams"].to_pylist()
        buckets = np.unique(np.concatenate([np.array(g, np.int64) for g in gram_lists]))
        size = len(names)
        known = np.array([1 + len(g) for g in gram_lists])
        parts = np.full((size, known.max()), size + len(buckets))
        for i, g in enumerate(gram_lists):
            parts[i, : known[i]] = [i, *(size + np.searchsorted(buckets, g))]
        inputs = np.concatenate([_start(word_keys, s.dim, s.seed), _start(buckets, s.dim, s.seed + 1), np.zeros((1, s.dim))])
        outputs = np.zeros((size, s.dim))
        if len(held):
            kinds, keys = held["kind"].to_numpy(), held["key"].to_numpy()
            vectors = held["vector"].combine_chunks().flatten().to_numpy().reshape(-1, s.dim)
            order = np.argsort(word_keys)
            for kind, into, at in ((WORD, inputs, None), (GRAM, inputs, buckets), (CONTEXT, outputs, None)):
                mine = kinds == kind
                rows = size + np.searchsorted(at, keys[mine]) if at is not None else order[np.searchsorted(word_keys[order], keys[mine])]
                into[rows] = vectors[mine]
        sentences = [np.array([place[w] for w in x if w in place], np.int64) for x in left["words"].to_pylist()]
        train_shard(sentences, words["n"].to_numpy().astype(np.float64), parts, known, inputs, outputs, s, rate, np.random.default_rng([s.seed, epoch, key[0].as_py()]), total)
        here = np.bincount(np.concatenate(sentences), minlength=size).astype(np.float64) if sentences else np.zeros(size)
        there = np.zeros(len(inputs))
        np.add.at(there, parts.ravel(), np.repeat(here, parts.shape[1]))
        vectors = np.concatenate([inputs[:-1], outputs]).astype(np.float32)
        return pa.table({
            "kind": pa.array(np.repeat([WORD, GRAM, CONTEXT], [size, len(buckets), size]), pa.int32()), "key": pa.array(np.concatenate([word_keys, buckets, word_keys])),
            "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, s.dim), pa.int32()), pa.array(vectors.ravel())), "weight": pa.array(np.maximum(np.concatenate([there[:-1], here]), 1e-9))})

    return run


def fit(sentences: DataFrame, settings: Settings = Settings(), words: str = "words") -> Model:
    """Train on an array of words for each row.

    Null arrays, null words and words rarer than ``settings.least`` are left out; longer sentences than 1000 words are cut; rows
    that repeat count each time.  Equal tables in equal files give equal vectors.  Word keys are 64-bit hashes.
    """
    s = settings
    texts = sentences.select(F.filter(F.col(words), lambda w: w.isNotNull()).alias("words")).where(F.size("words") > 0)
    cut = texts.select(F.explode(chunks(F.col("words"), LONGEST_SENTENCE)).alias("words"))
    counted = cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.least)
    vocabulary = materialize(counted, "subword-vocabulary")
    total = vocabulary.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError(f"no word occurs {s.least} times")
    shards = -(-total // s.shard_words)
    dealt = materialize(cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")), "subword-sentences")
    pairs = dealt.select("shard", F.explode("words").alias("word")).distinct()
    needs = materialize(pairs.join(vocabulary, "word").select("shard", "word", "n", F.xxhash64("word").alias("key"), grams(F.col("word"), s).alias("grams")), "subword-needs")
    keys = needs.select("shard", F.lit(WORD).alias("kind"), "key").unionByName(needs.select("shard", F.lit(CONTEXT).alias("kind"), "key"))
    keys = materialize(keys.unionByName(needs.select("shard", F.lit(GRAM).alias("kind"), F.explode("grams").alias("key")).distinct()), "subword-keys")
    parameters, old = None, []
    for epoch in range(s.epochs):
        right = needs.select("shard", F.lit(None).cast("int").alias("kind"), "key", F.lit(None).cast("array<float>").alias("vector"), "word", "n", "grams")
        if parameters is not None:
            right = right.unionByName(keys.join(parameters, ["kind", "key"]), allowMissingColumns=True)
        trained = dealt.select("shard", "words").groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_epoch(s, epoch, float(total)), PARAMETERS)
        old.append(parameters)
        parameters = materialize(_mean(trained, ["kind", "key"], s.dim), f"subword-epoch-{epoch}")
        discard(*[x for x in old[-1:] if x is not None])
    discard(dealt, needs, keys)
    return Model(s, vocabulary, parameters)
