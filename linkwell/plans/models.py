"""Estimators over feature tables, with ``pyspark.ml``.

Two rankers: a linear one learns from differences of rows of one query (the pairwise logistic loss); within a
query every row meets a bounded number of the other side, so pairs grow with the rows and not with their
square.  A boosted one fits a regression tree to the LambdaMART gradients of each round.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.functions import text
from linkwell.operators import metrics, retrieval, subwords
from linkwell.operators.ranking import dealt_lists
from linkwell.plans import neural
from linkwell.storage import discard, materialize, table


def gbt_classifier(train: DataFrame, features: list[str], label: str, depth: int = 10, rate: float = 0.1, rounds: int = 100, vali: str | None = None) -> PipelineModel:
    """Boosted trees with logistic loss; with a ``vali`` column training stops when its error grows."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=1)
    if vali:
        gbt = gbt.setValidationIndicatorCol(vali)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(train)


def mlp_classifier(train: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (100, 100), rounds: int = 100) -> PipelineModel:
    """Scaled features through a perceptron with the given hidden layers."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[len(features), *hidden, 2], maxIter=rounds, seed=1)]).fit(train)


def ranked_pairs(train: DataFrame, group: str, features: list[str], target: str, meets: int = 10) -> DataFrame:
    """(_g, p_*, n_*): pairs of a positive and a negative of one group, in which every row of a mixed group takes part.

    Rows are numbered in the order of a hash.  Each row of the larger side meets the next ``meets`` rows of the
    other, round and round, or all if there are fewer.
    """
    sizes = train.groupBy(F.col(group).alias("_g")).agg(*[F.count(F.when(F.col(target) == t, 1)).alias(n) for t, n in ((1, "_np"), (0, "_nn"))]).where("_np > 0 AND _nn > 0")
    order = Window.partitionBy(group).orderBy(F.xxhash64(*features), *features)
    step = lambda other: F.transform(F.sequence(F.lit(0), F.least(F.lit(meets), other) - 1), lambda j: F.pmod(F.col("_i") + j, other))

    def side(value: int, name: str, larger: Column, other: Column) -> DataFrame:
        rows = train.where(F.col(target) == value).withColumn("_i", (F.row_number().over(order) - 1).cast("long"))
        rows = rows.select(F.col(group).alias("_g"), "_i", *[F.col(f).cast("double").alias(f"{name}_{f}") for f in features]).join(sizes, "_g")
        return rows.withColumn("_slot", F.explode(F.when(larger, step(other)).otherwise(F.array("_i")))).drop("_i", "_np", "_nn")

    negatives_lead = F.col("_nn") >= F.col("_np")
    return side(1, "p", ~negatives_lead, F.col("_nn")).join(side(0, "n", negatives_lead, F.col("_np")), ["_g", "_slot"]).drop("_slot")


def pairwise_ranker(train: DataFrame, group: str, features: list[str], target: str, meets: int = 10) -> dict[str, float]:
    """Weights of a linear scorer that puts positives of a group above its negatives."""
    diff = ranked_pairs(train, group, features, target, meets).withColumn("_sign", F.when(F.xxhash64(*[f"n_{f}" for f in features]) % 2 == 0, 1.0).otherwise(-1.0))
    rows = diff.select(((F.col("_sign") + 1) / 2).alias("label"), *[((F.col(f"p_{f}") - F.col(f"n_{f}")) * F.col("_sign")).alias(f) for f in features])
    model = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=50).fit(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return dict(zip(features, (float(c) for c in model.coefficients)))


def lambdas(scores: np.ndarray, target: np.ndarray, k: int = 10) -> np.ndarray:
    """Gradients of one list: each pair of unequal targets pulls its better row up by what a swap would change in NDCG@k."""
    n = len(scores)
    place = np.empty(n, np.int64)
    place[np.argsort(-scores, kind="stable")] = np.arange(n)
    discount = np.where(np.arange(n) < k, 1 / np.log2(np.arange(n) + 2), 0)
    best = (np.sort(target)[::-1] * discount).sum()
    if best == 0:
        return np.zeros(n)
    better = target[:, None] > target[None, :]
    swap = np.abs((target[:, None] - target[None, :]) * (discount[place][:, None] - discount[place][None, :])) / best
    pull = np.where(better, swap / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50))), 0)
    return pull.sum(1) - pull.sum(0)


@dataclass(frozen=True)
class BoostedRanker:
    """Regression trees whose weighted sum ranks the rows of a query."""

    features: list[str]
    trees: list[DecisionTreeRegressionModel]
    rate: float

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df).withColumn(out, F.lit(0.0))
        for t in self.trees:
            rows = t.setFeaturesCol("_x").setPredictionCol("_leaf").transform(rows).withColumn(out, F.col(out) + self.rate * F.col("_leaf")).drop("_leaf")
        return rows.drop("_x")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for i, t in enumerate(self.trees):
            t.write().overwrite().save(f"{path}/tree-{i:04d}")
        spark.createDataFrame([(json.dumps({"features": self.features, "rate": self.rate, "trees": len(self.trees)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ranker")

    @classmethod
    def load(cls, path: str) -> BoostedRanker:
        held = json.loads(SparkSession.active().read.text(f"{path}/ranker").first()["value"])
        return cls(held["features"], [DecisionTreeRegressionModel.load(f"{path}/tree-{i:04d}") for i in range(held["trees"])], held["rate"])


def boosted_ranker(train: DataFrame, group: str, features: list[str], target: str, rounds: int = 50, depth: int = 5, rate: float = 0.1, list_size: int = 200, k: int = 10, vali: DataFrame | None = None, patience: int = 10) -> BoostedRanker:
    """LambdaMART: each round's tree is fitted to the gradients of NDCG@k under the scores so far.

    A longer list than ``list_size`` rows is dealt by a hash into lists of about that many, in each of which both classes
    stand in proportion; so every row takes part and no task holds a long list.  With ``vali`` rows training stops
    after ``patience`` rounds without a better mean NDCG, and the trees up to the best round stay.
    """
    lists = dealt_lists(train.select(F.col(group).alias("_k"), F.col(target).cast("double").alias("_t"), *features), "_k", features, list_size)
    rows = materialize(VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(lists).select("_g", "_t", "_x", F.lit(0.0).alias("_s")), "ranker")

    def gradient(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(_y=lambdas(frame["_s"].to_numpy(), frame["_t"].to_numpy(), k))[["_x", "_s", "_t", "_g", "_y"]]

    trees, best, at = [], -1.0, 0
    kinds = dict(rows.dtypes)
    for i in range(rounds):
        pulled = materialize(rows.withColumn("_x", vector_to_array("_x")).groupBy("_g").applyInPandas(gradient, f"_x array<double>, _s double, _t double, _g {kinds['_g']}, _y double"), "ranker-pull")
        held = pulled.withColumn("_x", array_to_vector("_x"))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", predictionCol="_leaf", maxDepth=depth, seed=1).fit(held)
        trees.append(tree)
        old, rows = rows, materialize(tree.transform(held).select("_g", "_t", "_x", (F.col("_s") + rate * F.col("_leaf")).alias("_s")), "ranker")
        discard(old, pulled)
        if vali is not None:
            scored = BoostedRanker(features, trees, rate).score(vali).withColumn("_tie", F.xxhash64(*features))
            now = metrics.ndcg(scored, [group], target, "score", "_tie", (k,)).agg(F.avg("ndcg")).first()[0] or 0.0
            best, at = (now, i) if now > best else (best, at)
            if i - at >= patience:
                break
    return BoostedRanker(features, trees[: at + 1] if vali is not None else trees, rate)


def embedding_classifier(train: DataFrame, label: str, size: int, q: str = "q_mean", d: str = "d_mean", hidden: tuple[int, ...] = (64, 32), rounds: int = 50) -> PipelineModel:
    """A perceptron over the mean word vectors of both sides and their distance, coordinate by coordinate."""
    rows = embedding_inputs(train, size, q, d)
    return mlp_classifier(rows, [c for c in rows.columns if c.startswith("_e")], label, hidden, rounds)


def embedding_inputs(rows: DataFrame, size: int, q: str = "q_mean", d: str = "d_mean") -> DataFrame:
    """Columns of both vectors and of their absolute difference; a missing vector counts as zero."""
    at = lambda c, i: F.coalesce(F.get(c, i).cast("double"), F.lit(0.0))
    return rows.select("*", *[x.alias(f"_e{n}_{i}") for i in range(size) for n, x in (("q", at(q, i)), ("d", at(d, i)), ("x", F.abs(at(q, i) - at(d, i))))])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def linear_score(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    total = sum((F.col(f).cast("double") * w for f, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, total)


def word_vectors(texts: DataFrame, tokens: str = "tokens", size: int = 100, window: int = 5, least: int = 5, rounds: int = 1, part_words: int = 5_000_000):
    """Word2Vec over token lists whose numbers are masked.

    Each round trains on all words, in tasks of about ``part_words`` words whose vectors are averaged; up to that many
    words are one task.  Several tasks of an executor train the same arrays at a time, so their vectors differ a little between runs.
    """
    masked = materialize(texts.select(text.mask_numbers(F.col(tokens)).alias(tokens)), "word2vec-tokens")
    total = masked.agg(F.sum(F.size(tokens))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, numPartitions=parts, seed=1, inputCol=tokens, outputCol="vector").fit(masked)
    discard(masked)
    return model


def _labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("chars"), F.size(text.words(F.col("text"))).cast("double").alias("n_words"),
        F.regexp_count("text", F.lit("[%&$#*|!]")).cast("double").alias("marks"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("capitals"))
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0)


FEATURES = ["chars", "n_words", "marks", "capitals"]


def _probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("doc_id", "quality", F.round(vector_to_array("probability")[1], 6).alias("prob"))


def gbt_query(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    return _probability(gbt_classifier(rows.where("NOT held_out"), FEATURES, "quality", depth=4, rounds=10), rows.where("held_out"))


def mlp_query(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    return _probability(mlp_classifier(rows.where("NOT held_out"), FEATURES, "quality", (20, 20), 40), rows.where("held_out"))


def ranker_query(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    weights = pairwise_ranker(rows.where("NOT held_out"), "source", FEATURES, "quality")
    return linear_score(rows.where("held_out"), weights).select("doc_id", "source", "quality", F.round("score", 6).alias("score"))


def boosted_ranker_query(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    model = boosted_ranker(rows.where("NOT held_out"), "source", FEATURES, "quality", rounds=4, depth=3, rate=0.5)
    return model.score(rows.where("held_out")).select("doc_id", "source", "quality", F.round("score", 6).alias("score"))


def neural_query(spark, d) -> DataFrame:
    rows = _labelled(spark, d)
    model = neural.train(rows.where("NOT held_out"), "source", FEATURES, "quality", neural.Settings(hidden=(32, 16), dropout=0.1, rate=0.1, steps=40, slices=2))
    return model.score(rows.where("held_out")).select("doc_id", "source", "quality", F.round("score", 6).alias("score"))


def subword_query(spark, d) -> DataFrame:
    """The nearest words of part names, for those names with their second letter left out."""
    names = table(spark, d, "part").select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("words"))
    model = subwords.fit(names, subwords.Settings(dim=32, epochs=3, least=2, buckets=50_000, sample=0, shard_words=20_000))
    word = model.vocabulary.where(F.length("word") > 4).select(F.concat(F.left("word", F.lit(1)), F.substr("word", F.lit(3))).alias("word"))
    return model.neighbours(word, 3).select("q", "rank", "word", F.round("cosine", 6).alias("cosine"))


def neighbours_query(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(retrieval.ascii_terms(F.col("text")).alias("tokens"))
    return word_vectors(docs, size=32).findSynonyms("the", 10).select("word", F.round("similarity", 6).alias("similarity"))


QUERIES = {"gbt_classifier": gbt_query, "mlp_classifier": mlp_query, "pairwise_ranker": ranker_query, "boosted_ranker": boosted_ranker_query, "neural_ranker": neural_query, "subword_neighbors": subword_query, "word2vec_neighbors": neighbours_query}
