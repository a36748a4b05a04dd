import math

import pytest
from pyspark.sql import functions as F

from linkwell.operators import entities, features, joins, metrics, ranking, sampling, scale, vectors
from linkwell.plans import models


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_unique_links(spark):
    feed = spark.createDataFrame([(1, 100), (2, 200), (2, 201), (3, 300), (4, 400)], "f long, code long")
    master = spark.createDataFrame([(50, 100), (60, 200), (60, 201), (70, 300), (71, 300)], "m long, code long")
    assert rows(joins.unique_links(feed, master, "f", "m", "code"), "f") == [(1, 100, 50)]


@pytest.mark.parametrize(("true_id", "expected"), [
    (11, [(10, 0.6, 0, True, 0), (11, 0.3, 1, True, 1), (12, 0.1, 0, True, 2)]),
    (99, [(99, 0.0, 1, True, -1), (11, 0.3, 0, True, 1), (12, 0.1, 0, True, 2)]),
    (None, [(10, 0.6, 0, False, 0), (11, 0.3, 0, False, 1), (12, 0.1, 0, False, 2)]),
])
def test_label(spark, true_id, expected):
    found = spark.createDataFrame([(1, None, 10, 6.0, 0), (1, None, 11, 3.0, 1), (1, None, 12, 1.0, 2)], "qid long, synid long, fid long, score double, ix int")
    truth = spark.createDataFrame([(1, true_id)] if true_id else [], "qid long, true_id long")
    got = sorted(rows(sampling.label(found, truth).select("fid", F.round("score", 6), "target", "existing", "ix"), "fid"), key=lambda r: abs(r[4]) if r[4] >= 0 else 0)
    assert got == expected


def test_positions_and_recall(spark):
    queries = spark.createDataFrame([(q, None) for q in range(5)], "qid long, synid long")
    truth = spark.createDataFrame([(q, 100 + q) for q in range(5)], "qid long, true_id long")
    found = spark.createDataFrame([(0, None, 100, 0), (1, None, 101, 0), (2, None, 5, 0), (2, None, 6, 1), (2, None, 102, 2), (4, None, 9, 0)], "qid long, synid long, fid long, ix int")
    pos = sampling.positions(queries, found, truth)
    assert [r[-1] for r in rows(pos, "et_id")] == [0, 0, 2, -1, -2]
    assert rows(metrics.recall_at(pos), "n") == [(1, 0.4, 0.4), (3, 0.2, pytest.approx(0.6))]
    samples = spark.createDataFrame([(1, i) for i in (0, 3, -1, 1)], "target int, ix int")
    assert metrics.recall_scale(samples).first()[0] == 0.75


def judged(spark, rel):
    return spark.createDataFrame([(1, i, r, float(len(rel) - i)) for i, r in enumerate(rel)], "g int, id int, rel int, score double")


@pytest.mark.parametrize(("rel", "k", "method", "dcg"), [([3, 2, 3, 0, 0, 1, 2, 2, 3, 0], k, m, v) for k, m, v in ((1, 0, 3.0), (1, 1, 3.0), (2, 0, 5.0), (2, 1, 4.2618595071429155), (10, 0, 9.605117739188811), (10, 1, 8.318753101481006))])
def test_dcg(spark, rel, k, method, dcg):
    assert metrics.ndcg(judged(spark, rel), ["g"], "rel", "score", "id", (k,), method).first().dcg == pytest.approx(dcg)


def test_ndcg(spark):
    value = lambda rel, k, m=1: metrics.ndcg(judged(spark, rel), ["g"], "rel", "score", "id", (k,), m).first().ndcg
    assert value([2, 1, 2, 0], 4, 0) == pytest.approx(0.9203032077642922) and value([2, 1, 2, 0], 4) == pytest.approx(0.9651954696014428)
    assert value([0], 1) == 0 and value([1], 2) == 1
    for place, expected in enumerate([1, 1 / math.log2(3), 0, 0]):
        assert value([int(i == place) for i in range(6)], 2) == pytest.approx(expected)


def test_abstention(spark):
    df = spark.createDataFrame([("A", 1, 0.9, 0), ("A", 2, 0.6, 1), ("B", 3, 0.4, 0)], "g string, id int, prob double, target int")
    got = {(r.topn, round(r.threshold, 2)): r for r in metrics.abstention_curve(df, ["g"], "target", "prob", "id", (1, 2)).collect()}
    assert len(got) == 202 and all(r.tp + r.fp + r.tn + r.fn == 2 for r in got.values())
    assert got[1, 0.5][2:8] == (0, 1, 1, 0, 0.0, None)
    assert got[2, 0.5][2:8] == (1, 0, 1, 0, 1.0, 1.0)
    assert got[2, 0.95][2:8] == (0, 0, 1, 1, 1.0, 0.0)
    assert got[2, 0.9].tp == 1 and got[2, 0.91].tp == 0
    assert got[2, 0.3].mean_precision == pytest.approx(sum(r.precision for r in got.values() if r.topn == 2) / 101)
    half = metrics.abstention_curve(df, ["g"], "target", "prob", "id", (2,), scale=spark.createDataFrame([(0.5,)], "s double"))
    assert {round(r.threshold, 2): r.recall for r in half.collect()}[0.5] == 0.5


def test_splits_keep_organisations_whole(spark):
    data = spark.createDataFrame([(i, f"o{i % 13}") for i in range(400)] + [(1000 + i, "big") for i in range(90)], "id int, org string")
    out = sampling.nested_split(data, "org", 0.2)
    assert out.count() == 490
    assert out.groupBy("org").agg(F.countDistinct("train", "vali").alias("n")).where("n > 1").isEmpty()
    train, vali, test = sampling.parts(out)
    assert test.count() > 0 and vali.where("NOT train").isEmpty() and train.count() + vali.count() + test.count() == 490
    assert sampling.parts(data)[2].count() == 490


def test_a_missing_organisation_stays_whole(spark):
    data = spark.createDataFrame([(i, "a") for i in range(4)] + [(10 + i, None) for i in range(5)] + [(20 + i, "c") for i in range(60)], "id int, org string")
    for seed in ("test", "split", "x", "y"):
        split = {r.org: r.test for r in sampling.org_split(data, "org", 0.6, seed).collect()}
        assert set(split) == {"a", None, "c"}
    out = sampling.nested_split(data, "org", 0.6)
    tested = {r.org for r in sampling.org_split(data, "org", 0.6, "test").where("test").collect()}
    assert None in tested and out.count() == 69
    assert {r.org for r in out.where("NOT train").collect()} == tested and out.where("org IS NULL AND train").isEmpty()


def test_samples(spark):
    matched, rest = spark.range(4).toDF("k"), spark.range(100, 150).toDF("k")
    got = sampling.balanced(matched, rest, "k", "s").collect()
    assert sum(r.matched for r in got) == 4 and sum(not r.matched for r in got) == 4
    assert sorted(map(tuple, sampling.balanced(matched, rest.repartition(7), "k", "s").collect())) == sorted(map(tuple, got))
    places = [r.place for r in sampling.shuffled(rest, F.col("k"), "s").orderBy("place").collect()]
    assert places == list(range(1, 51))
    asking = spark.createDataFrame([(1, None, [5, 6], 77), (2, 9, [7], 78), (3, None, [8], 79)], "qid long, synid long, barcodes array<long>, src_id long")
    found = spark.createDataFrame([(1, None, 10, 0), (1, None, 11, 1), (2, 9, 10, 0)], "qid long, synid long, fid long, ix int")
    codes = spark.createDataFrame([(10, [1]), (11, [6, 2])], "fid long, barcodes array<long>")
    assert rows(sampling.barcode_positions(asking, found, codes), "et_id") == [(1, None, 11, 1), (2, 9, 78, -2), (3, None, None, -1)]


def test_running_sums_and_skewed_joins(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 5) for i in range(101)], "k long, v long").repartition(6)
    got = rows(scale.running(df, [F.desc("k")], {"s": F.col("v"), "n": F.lit(1).cast("long")}).select("k", "n", "s"), F.desc("k"))
    held = {r.k: r.v for r in df.collect()}
    assert got == [(100 - i, i + 1, sum(held[k] for k in range(100 - i, 101))) for i in range(101)]
    left = spark.createDataFrame([(1, i) for i in range(5000)] + [(i, i) for i in range(2, 50)], "k long, x long")
    right = left.where("k < 40").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.col("k") * 2)
    assert scale.skewed_join(left, right, "k", "n").agg(F.count(F.lit(1)), F.sum("y")).first()[:] == (5038, 10000 + 2 * sum(range(2, 40)))
    assert scale.skewed_join(left, right, "k", "n", "left").where("y IS NULL").count() == 10


def test_feature_table(spark):
    texts = spark.createDataFrame([(1, None, ["a", "b", "a"]), (2, 5, ["z"]), (3, None, [])], "qid long, synid long, tokens array<string>")
    vectors_ = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<double>")
    assert [r.tokens for r in features.known_tokens(texts, ["qid", "synid"], vectors_).orderBy("qid").collect()] == [["a", "b", "a"], [], []]
    ids = features.vocabulary_ids(texts, ["qid", "synid"], spark.createDataFrame([("a", 4), ("z", 9)], "word string, id int"))
    assert [r.ids for r in ids.orderBy("qid").collect()] == [[4, -1, 4], [9], []]
    q = features.token_vectors(texts, ["qid", "synid"], vectors_)
    assert [r.vectors for r in q.orderBy("qid").collect()] == [[[1.0, 0.0], [0.0, 2.0], [1.0, 0.0]], [], []]
    samples = spark.createDataFrame([(1, None, 7, 1, 0.5, 0, ["a", "b"], ["a"]), (1, None, 7, 1, 0.1, 3, ["a", "b"], ["a"]), (2, 5, 7, 0, 0.2, 1, ["z"], ["a"])], "qid long, synid long, fid long, target int, score double, ix int, q_terms array<string>, d_terms array<string>")
    d = spark.createDataFrame([(7, [[1.0, 0.0]])], "fid long, vectors array<array<double>>")
    weights = vectors.tfidf(spark.createDataFrame([(1, ["a", "b"]), (7, ["a"])], "id long, terms array<string>"))
    side = weights.where("id = 1").select(F.col("id").alias("qid"), F.lit(None).cast("long").alias("synid"), "words", "weights")
    out = features.pair_dataset(samples, [features.vector_distances(samples, q, d), features.tfidf_distances(samples, side, weights.withColumnRenamed("id", "fid"))]).orderBy("qid").collect()
    assert len(out) == 2 and out[0].score == 0.5 and out[0].ix == 0
    assert out[0].fasttext0 == pytest.approx(1 - 2 / math.sqrt(8)) and [out[0].fasttext1, out[0].fasttext2] == pytest.approx([1 / 3, 0])
    assert [out[1][f"fasttext{i}"] for i in range(4)] == [-1, -1, -1, -1] and out[1].tfidf0 == 0.5 and out[0].lvn_1 == 0.5
    pred = features.with_predictions(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2, 0.7)], "id long, prob double"))
    assert rows(pred, "id") == [(1, None), (2, 0.7)]
    product = "id long, name string, description string, synonyms array<struct<id:long,name:string>>, mistypes array<struct<name:string>>"
    feed = spark.createDataFrame([(1, "a b", None, [(4, "c")], None), (2, "gone", None, None, None)], product)
    master = spark.createDataFrame([(2, "m", "d e", None, [("x",)])], product)
    held_out = spark.createDataFrame([(2,)], "qid long")
    got = features.training_sentences(feed, master, held_out, lambda t: F.split(t, " ")).collect()
    assert sorted(" ".join(r.words) for r in got) == ["a b", "c", "d e", "m", "x"]
    assert [r.all_names for r in entities.joined_names(feed).orderBy("id").collect()] == [["c"], []]


def test_boosted_ranker(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(3)
    score, target = r.normal(size=12), r.integers(0, 3, 12).astype(float)
    pull = models.lambdas(score, target, 12)
    assert pull.sum() == pytest.approx(0) and pull[target == 2].mean() > pull[target == 0].mean() and not models.lambdas(score, target * 0).any()
    data = [(int(g), float(x), float(y), int(x * x + y > 1.2)) for g in range(40) for x, y in r.random((12, 2))]
    df = spark.createDataFrame(data, "g int, x double, y double, t int")
    model = models.boosted_ranker(df.where("g < 30"), "g", ["x", "y"], "t", rounds=6, depth=4, rate=0.5)
    quality = lambda m: metrics.ndcg(m.score(df.where("g >= 30")).withColumn("i", F.xxhash64("x", "y")), ["g"], "t", "score", "i", (10,)).agg(F.avg("ndcg")).first()[0]
    assert quality(model) > 0.93
    model.save(str(tmp_path / "ranker"))
    assert quality(models.BoostedRanker.load(str(tmp_path / "ranker"))) == pytest.approx(quality(model))


def test_embedding_classifier(spark, tmp_path):
    import random

    r = random.Random(1)
    data = []
    for i in range(300):
        a = [r.random() for _ in range(3)]
        same = i % 2
        data.append((a if i else None, [x + r.gauss(0, 0.02) if same else r.random() for x in a], same))
    df = spark.createDataFrame(data, "q_mean array<double>, d_mean array<double>, y int")
    model = models.embedding_classifier(df, "y", 3, hidden=(8,), rounds=80)
    models.save_model(model, str(tmp_path / "m"))
    got = models.load_model(str(tmp_path / "m")).transform(models.embedding_inputs(df, 3)).where("prediction = y").count()
    assert got > 240


def test_entities(spark):
    products = spark.createDataFrame(
        [(1, "Сок", "{Org A|x", [(7, "Сок яблочный", "{Org B|y"), (8, "Сок", "merged with master")]), (2, "Чай", "{Org A", []), (3, " ", "{Org A", [])],
        "id long, name string, comment string, synonyms array<struct<id:long,name:string,comment:string>>")
    links = spark.createDataFrame([(1, 50)], "_id long, _id_release long")
    assert rows(entities.query_names(products, links), "qid", "synid") == [(1, 7, "Сок яблочный"), (1, 8, "Сок"), (2, None, "Чай")]
    assert rows(entities.organisations(products).where("qid = 1"), "synid") == [(1, None, "Org A"), (1, 7, "Org B"), (1, 8, "Org A")]
    pairs = spark.createDataFrame([(["a"], ["a"], 0), (["a"], ["a"], 1), ([], ["a"], 1), (["a"], ["b"], 0)], "q_terms array<string>, d_terms array<string>, target int")
    assert entities.without_noise(pairs).count() == 2
    asked = spark.createDataFrame([(1, 7), (1, None), (1, 99), (5, 1)], "qid long, synid long")
    assert rows(entities.synonym_name(asked, products), "qid", "synid") == [(1, None, "Сок"), (1, 7, "Сок яблочный"), (1, 99, None), (5, 1, None)]
    placed = spark.createDataFrame([(1, 0), (1, -1), (2, 3)], "qid long, ix int")
    assert rows(entities.with_existing(placed), "qid") == [(2, 3)] and entities.retrieved(placed).count() == 2
    texts = spark.createDataFrame([(1, None), (2, None), (None, 8)], "qid long, fid long")
    assert sorted(map(tuple, entities.for_fitting(texts, placed.where("qid = 1")).select("qid", "fid").collect()), key=str) == [(2, None), (None, 8)]
    links = spark.createDataFrame([(1, 50), (1, 40), (None, 9)], "f long, m long")
    assert rows(joins.lookup_link(spark.createDataFrame([(1,), (2,), (None,)], "id long"), "id", links, "f", "m", "existing"), F.col("id").asc_nulls_last()) == [(1, 40), (2, None), (None, None)]


def test_lookups(spark):
    df, names = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, k long"), spark.createDataFrame([(5, "Five")], "k long, name string")
    assert rows(joins.lookup_optional(df, "k", names, "k", "name", "out").select("id", "out"), "id") == [(1, "five"), (2, ""), (3, "")]
    with pytest.raises(Exception, match="no name for k"):
        joins.lookup_required(df, "k", names, "k", "name", "out").collect()
    assert joins.null_safe(df, df.select("k").withColumn("x", F.lit(1)), ["k"]).count() == 3


def test_ranking(spark):
    df = spark.createDataFrame([(5, None, 1.0, 1), (5, None, 1.0, 0), (2, 7, 3.0, 0), (2, 8, 4.0, 1)], "qid long, synid long, x double, target int")
    got = rows(ranking.number_groups(df, ["qid", "synid"]).select("qid", "synid", "group_no"), "group_no")
    assert got == [(2, 7, 1), (2, 8, 2), (5, None, 3), (5, None, 3)]
    assert rows(ranking.mixed_groups(df, ["qid"]).select("qid"), "qid") == [(2,), (2,), (5,), (5,)]
    one = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, b double")
    assert [tuple(round(v, 4) for v in r) for r in ranking.standard_scale(one, ["a", "b"]).orderBy("a").collect()] == [(-1.0690, 0.0), (-0.2673, 0.0), (1.3363, 0.0)]


def test_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, [])], "id long, terms array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 4)], "q long, d long")
    got = {(r.q, r.d): r.distance for r in vectors.paired_distance(pairs, vectors.tfidf(docs)).collect()}
    assert got[1, 2] == pytest.approx(0) and got[1, 3] == pytest.approx(1) and got[1, 4] == 0.5 and got[4, 4] == 0
    sets = spark.createDataFrame([([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]]), ([], [[1.0, 0.0]])], "q array<array<double>>, d array<array<double>>")
    assert [tuple(r) for r in sets.select(*vectors.set_distances(F.col("q"), F.col("d")).values()).collect()] == [(0.0, 0.0, 0.0), (-1.0, -1.0, -1.0)]


def test_nearest_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11) + 1, float(i * i % 13)]) for i in range(60)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vectors.nearest(rows, rows, 3).collect()))
    assert len(whole) == 180
    assert sorted(map(tuple, vectors.nearest(rows, rows, 3, most=7).collect())) == whole


def test_every_row_trains_the_ranker(spark):
    # group a: more negatives, b: more positives, c: no positive
    labelled = [("a", 1, 0.0), ("a", 1, 1.0), *[("a", 0, 100.0 + i) for i in range(30)], *[("b", 1, 200.0 + i) for i in range(50)], *[("b", 0, 300.0 + i) for i in range(12)], ("c", 0, 400.0)]
    pairs = models.ranked_pairs(spark.createDataFrame(labelled, "g string, t int, x double"), "g", ["x"], "t", 10).collect()
    assert len({(r._g, r.p_x, r.n_x) for r in pairs}) == len(pairs) == 30 * 2 + 50 * 10
    assert {(r._g, v) for r in pairs for v in (r.p_x, r.n_x)} == {(g, x) for g, _, x in labelled if g != "c"}


def test_tfidf_sends_the_most_frequent_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (2, ["a", "b", "d", "e", "e"]), (3, []), (4, ["f"]), (5, None)], "id long, terms array<string>")
    fit = docs.where("id < 4")
    found = lambda on: sorted((r["id"], r["words"], [round(w, 12) for w in r["weights"]]) for r in vectors.tfidf(docs, on).collect())
    whole = found(None), found(fit)
    assert sorted(len(w) for _, w, _ in whole[0]) == [1, 2, 2, 4] and len(whole[1]) == 3
    frequencies = spark.createDataFrame([(1, 9), (2, 8), (3, 3), (4, 1), (5, 1)], "word long, df long")
    for most, least in ((5, 1), (4, 2), (2, 4), (1, 16)):
        monkeypatch.setattr(vectors, "BROADCAST_TERMS", most)
        assert vectors._least_sent(frequencies) == least
        assert (found(None), found(fit)) == whole


def test_index_documents_deals_out_the_rows_of_one_split(spark):
    synonyms = F.array(F.struct(F.concat(F.lit("Сок "), F.col("id").cast("string")).alias("name")))
    products = spark.range(200).select(
        F.when(F.col("id") > 20, F.col("id")).alias("id"), F.concat(F.lit("Juice "), F.col("id").cast("string"), F.lit("ml")).alias("name"), F.lit(1).cast("long").alias("brand_id"),
        F.lit(2).cast("long").alias("category_id"), F.array(F.lit("x")).alias("barcodes"), F.lit("").alias("source"), F.lit("Шт.").alias("unit_name"), synonyms.alias("synonyms")).coalesce(1)
    brands, kinds = spark.createDataFrame([(1, "Best")], "id long, name string"), spark.createDataFrame([(2, "Drinks")], "id long, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = entities.index_documents(products, brands, kinds).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 200 and sorted(r.id for r in found if r.id) == list(range(21, 200))
    # rows without an id are dealt out too
    assert len({r.task for r in found if r.id}) > 4 and len({r.task for r in found if r.id is None}) > 1
    assert [tuple(r)[1:-1] for r in found if r.id == 30] == [("йуице 30 мл бест", 2, "Drinks", ["x"], None, "шт", "сок 30")]
