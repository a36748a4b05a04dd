"""Train and evaluate in one call: ranking files or a feature table in, a model and its report tables out.

Every table of a report is written as CSV with a header below ``out`` and returned, the model is saved beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.operators import metrics
from linkwell.operators.ranking import feature_columns
from linkwell.operators.sampling import parts
from linkwell.plans import models, neural
from linkwell.sources import tables
from linkwell.storage import materialize


def _written(report: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    held = {name: materialize(df, f"report-{name}") for name, df in report.items()}
    for name, df in held.items():
        tables.write_table(df.coalesce(1) if name != "predictions" else df, f"{out}/{name}.csv")
    return held


def rank(
    spark: SparkSession, folder: str, n_features: int, out: str, method: str = "boosted", retrieved: DataFrame | None = None, scale: float = 1.0, cuts: tuple[int, ...] = (1, 2, 5, 6, 7, 10),
    settings: dict | None = None,
) -> dict[str, DataFrame]:
    """Rank the lists of ``folder``/test.txt by a model of train.txt, with vali.txt to stop a boosted one: ranking text as ``write_ranking`` writes it.

    ``method``: boosted, neural or linear, with ``settings`` of its trainer.  ``retrieved`` (i) has the places at which retrieval
    found the true rows, for a second curve; ``scale`` is the share of true rows that retrieval found at all.  Tables: predictions,
    ndcg, places (of the first relevant row), found and found_by_retrieval (share of lists found in the first n).
    Ties of scores go by a hash of the features.
    """
    features = [f"f{i}" for i in range(1, n_features + 1)]
    train, vali, test = (tables.read_ranking(spark, f"{folder}/{part}.txt", n_features) for part in ("train", "vali", "test"))
    given = settings or {}
    if method == "boosted":
        model = models.boosted_ranker(train, "qid", features, "target", vali=vali, **given)
        scored = model.score(test)
    elif method == "neural":
        model = neural.train(train.unionByName(vali), "qid", features, "target", neural.Settings(**given))
        scored = model.score(test)
    elif method == "linear":
        model = models.pairwise_ranker(train.unionByName(vali), "qid", features, "target", **given)
        scored = models.linear_score(test, model)
    else:
        raise ValueError(f"no such method: {method}")
    if method == "linear":
        spark.createDataFrame(sorted(model.items()), "feature string, weight double").coalesce(1).write.mode("overwrite").json(f"{out}/model")
    else:
        model.save(f"{out}/model")
    scored = materialize(scored.withColumn("tie", F.xxhash64(*features)), "scored")
    places = metrics.first_relevant(scored, ["qid"], "target", "score", "tie")
    found = lambda df: metrics.recall_at(df, scale).orderBy("n")
    report = {
        "predictions": scored.select("qid", "target", *features, "score"), "ndcg": metrics.mean_ndcg(metrics.ndcg(scored, ["qid"], "target", "score", "tie", cuts)).orderBy("k"), "places": places,
        "found": found(places.select(F.coalesce("pos", F.lit(-1)).alias("i")))}
    if retrieved is not None:
        report["found_by_retrieval"] = found(retrieved.select("i"))
    return _written(report, out)


def classify(rows: DataFrame, out: str, scale: DataFrame | None = None, threshold: float = 0.5, depth: int = 10, rate: float = 0.1, rounds: int = 100) -> dict[str, DataFrame]:
    """A boosted classifier of a feature table with its keys, target, ix and the flags of ``sampling.nested_split``.

    True rows that retrieval missed (ix -1) are left out, as no answer could name them; ``scale`` (one value) says how many
    were found.  Training stops by the validation rows.  Tables: train_report, report, predictions (of test rows), precision_recall,
    average_precision, confusion, abstention, histogram and best (each query's best probability).
    """
    held = rows.where("ix <> -1")
    features = feature_columns(held)
    train, vali, test = parts(held)
    learn = train.withColumn("_stop", F.lit(False)).unionByName(vali.withColumn("_stop", F.lit(True)))
    model = models.gbt_classifier(learn, features, "target", depth, rate, rounds, vali="_stop")
    models.save_model(model, f"{out}/model")
    prob = lambda df: materialize(model.transform(df).select("qid", "synid", "fid", "target", models.vector_to_array("probability")[1].alias("prob")), "predicted")
    mine, seen = prob(test), prob(train)
    curve = materialize(metrics.pr_curve(mine, "target", "prob"), "curve")
    return _written({
        "train_report": metrics.report(seen, "target", "prob", threshold), "report": metrics.report(mine, "target", "prob", threshold), "predictions": mine, "precision_recall": curve.drop("step").orderBy("recall"),
        "average_precision": metrics.average_precision(curve), "confusion": metrics.confusion(mine, "target", "prob", threshold),
        "abstention": metrics.abstention_curve(mine, ["qid"], "target", "prob", "fid", scale=scale).orderBy("topn", "threshold"), "histogram": metrics.histogram(mine, "target", "prob"),
        "best": mine.groupBy("qid").agg(F.max("prob").alias("best"))}, out)
