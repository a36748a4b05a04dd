"""From ranking files and from a feature table to a saved model and its report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.plans import experiments, models
from linkwell.sources import tables


def rows(spark, groups, seed):
    r = np.random.default_rng(seed)
    data = []
    for g in groups:
        x = r.random((8, 2))
        best = int(np.argmax(x[:, 0] - 0.5 * x[:, 1]))
        data += [(int(g), None, i, int(i == best), float(a), float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(data, "qid long, synid long, fid long, target int, a double, b double")


def test_rank_from_files(spark, tmp_path):
    for part, groups in (("train", range(40)), ("vali", range(40, 50)), ("test", range(50, 70))):
        tables.write_ranking(rows(spark, groups, 7), f"{tmp_path}/{part}", ["qid", "synid"], "target", ["a", "b"], ["fid"])
    retrieved = spark.createDataFrame([(0,), (3,), (-1,), (0,)], "i int")
    got = {}
    for method, settings in (("linear", {}), ("boosted", {"rounds": 5, "depth": 3, "rate": 0.5}), ("neural", {"hidden": (8,), "steps": 12, "slices": 1, "rate": 0.3, "dropout": 0.0})):
        report = experiments.rank(spark, str(tmp_path), 2, f"{tmp_path}/{method}", method, retrieved, 0.5, settings=settings)
        got[method] = {r.k: r.ndcg for r in report["ndcg"].collect()}
        assert report["predictions"].count() == 160 and report["places"].count() == 20
        found = [r.recall for r in report["found"].collect()]
        assert found == sorted(found) and found[-1] == pytest.approx(0.5)
        assert [(r.n, r.recall) for r in report["found_by_retrieval"].collect()] == [(1, 0.25), (4, 0.375)]
        held = spark.read.option("header", True).csv(f"{tmp_path}/{method}/ndcg.csv")
        assert {int(r.k): float(r.ndcg) for r in held.collect()} == got[method]
    assert got["linear"][1] > 0.8 and min(m[2] for m in got.values()) > 0.6
    assert len(models.BoostedRanker.load(f"{tmp_path}/boosted/model").features) == 2
    with pytest.raises(ValueError):
        experiments.rank(spark, str(tmp_path), 2, str(tmp_path), "none")


def test_classify_a_feature_table(spark, tmp_path):
    flags = rows(spark, range(60), 3).withColumns({"ix": F.when((F.col("qid") == 5) & (F.col("target") == 1), -1).otherwise(F.col("fid").cast("int")), "train": F.col("qid") < 45, "vali": (F.col("qid") >= 38) & (F.col("qid") < 45)})
    scale = spark.createDataFrame([(0.9,)], "s double")
    report = experiments.classify(flags, f"{tmp_path}/out", scale, depth=3, rounds=8)
    assert set(report) == {"train_report", "report", "predictions", "precision_recall", "average_precision", "confusion", "abstention", "histogram", "best"}
    one = report["report"].first()
    assert report["predictions"].count() == 15 * 8 and one.support == 15 and one.accuracy > 0.85 and report["best"].count() == 15
    assert report["average_precision"].first().ap > 0.6 and report["abstention"].agg(F.max("recall")).first()[0] <= 0.9
    assert models.load_model(f"{tmp_path}/out/model").transform(flags.limit(3)).count() == 3
