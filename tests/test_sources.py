import json
import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkwell.functions.strings import lcs_length
from linkwell.operators.retrieval import ascii_terms, bm25_topk, build_index, open_index, search, shared_run_truth, term_counts
from linkwell.options import Options
from linkwell.sources import feeds, tables
from linkwell.streaming.matching import match_stream

DUMP = {"Database": [{"version": 3, "etalons": [{"id": 1, "name": "Сок"}, {"id": 2, "name": "Чай"}], "brands": [{"id": 5, "name": "Домик"}], "units": []}]}
SCHEMA = "Database array<struct<version:long,etalons:array<struct<id:long,name:string>>,brands:array<struct<id:long,name:string>>,units:array<struct<id:long>>>>"


def test_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DUMP))
    found = feeds.read_feed(spark, str(tmp_path / "a.json"))
    assert sorted(found) == ["brands", "etalons"] and found["etalons"].count() == 2 and "_id" in found["brands"].columns
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("dump.json", json.dumps(DUMP if name == "b" else {"Database": []}))
    zipped = feeds.read_zipped_feed(spark, str(tmp_path / "*.zip"), StructType.fromDDL(SCHEMA))
    assert zipped["etalons"].count() == 2
    feeds.write_feed(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/etalons.parquet")).count() == 2
    assert list(feeds.dictionaries(found)) == ["brands"]
    assert [r.key for r in feeds.rows_by_key(found, "etalons").orderBy("key").collect()] == [1, 2] and feeds.rows_by_key(found, "units") is None
    held = {"units": spark.createDataFrame([(1, "кг")], "_id long, name string"), "featureValues": spark.createDataFrame([(3, "red"), (4, "red")], "_id long, value string")}
    assert feeds.rows_by_key(held, "units").first().key == "кг" and feeds.ids_by_name(held, "units") is None
    assert tuple(feeds.ids_by_name(held, "featureValues").first()) == ("red", 4) and feeds.ids_by_name(found, "brands").first().id == 5


def test_ranking_text(spark, tmp_path):
    df = spark.createDataFrame([(9, 1, 10, 0, 0.5, 2.0), (9, 1, 11, 1, 1.5, 3.0), (2, None, 12, 1, 0.25, 4.0)], "qid long, synid long, fid long, target int, a double, b double")
    path = str(tmp_path / "rank")
    tables.write_ranking(df, path, ["qid", "synid"], "target", ["a", "b"], ["fid"])
    lines = [r.value for r in spark.read.text(f"{path}.txt").collect()]
    assert sorted(lines) == ["0 qid:2 1:0.500000 2:2.000000", "1 qid:1 1:0.250000 2:4.000000", "1 qid:2 1:1.500000 2:3.000000"]
    assert sorted(tuple(r) for r in tables.read_ranking(spark, f"{path}.txt", 3).collect()) == [(0, 2, 0.5, 2.0, 0.0), (1, 1, 0.25, 4.0, 0.0), (1, 2, 1.5, 3.0, 0.0)]
    assert sorted(r.n for r in tables.read_groups(spark, f"{path}.group").collect()) == [1, 2]
    assert tables.read_ids(spark, f"{path}.ix").where("synid IS NULL").count() == 1


def test_csv_and_padding(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0, "a,b", "c")], "id long, label int, left_name string, right_name string")
    tables.write_pairs(pairs, str(tmp_path / "pairs"))
    (tmp_path / "p.csv").write_text("id,match_score\n1,0.5\n")
    assert tables.read_predictions(spark, str(tmp_path / "p.csv")).first().prob == 0.5
    assert max((f.read_text() for f in (tmp_path / "pairs").glob("*.csv")), key=len) == 'id,label,left_name,right_name\n1,0,"a,b",c\n'
    rows = spark.createDataFrame([([1, 2, 3],), ([1],)], "a array<int>")
    assert [r.a for r in tables.padded(rows, "a", 2, 0).collect()] == [[1, 2], [1, 0]]
    assert lcs_length("abc", "ac") == 2


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red bolt"), (2, "blue nut")], "id long, text string")
    docs = docs.select("id", ascii_terms(docs.text).alias("terms"))
    spark.createDataFrame([(7, ["blue"])], "qid long, terms array<string>").write.parquet(str(tmp_path / "in"))
    got = []
    queries = spark.readStream.schema("qid long, terms array<string>").parquet(str(tmp_path / "in"))
    index = build_index(docs, path=str(tmp_path / "index"))
    match_stream(queries, index, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert [(r.qid, r.fid, r.ix) for r in got] == [(7, 2, 0)]


def brute_bm25(queries, docs, boosts, n):
    out = []
    for qid, asked in queries:
        scores = {}
        for field, boost in boosts.items():
            held = [(i, t[field]) for i, t in docs]
            mean = sum(len(t) for _, t in held) / len(held)
            for term, qtf in Counter(asked).items():
                df = sum(term in t for _, t in held)
                for i, t in held:
                    if tf := t.count(term):
                        scores[i] = scores.get(i, 0) + boost * qtf * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:n]
        out += [(qid, i, -s, k) for k, (s, i) in enumerate(best)]
    return sorted(out)


def test_search(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    word = lambda: f"w{min(int(r.expovariate(0.15)), 60)}"
    docs = [(i, {"name": [word() for _ in range(r.randint(0, 12))], "syn": [word() for _ in range(r.randint(0, 5))]}) for i in range(300)]
    docs += [(300 + i, docs[3][1]) for i in range(40)]  # ties
    queries = [(q, [word() for _ in range(r.randint(0, 9))]) for q in range(40)] + [(99, ["unknown"])]
    df = spark.createDataFrame([(i, t["name"], t["syn"], 1) for i, t in docs], "id long, name array<string>, syn array<string>, dl_name int").repartition(5)
    asked = spark.createDataFrame(queries, "qid long, terms array<string>")
    boosts = {"name": 5.0, "syn": 1.0}
    build_index(df, ["name", "syn"], str(tmp_path / "index"))
    index = open_index(spark, str(tmp_path / "index"))
    expected = brute_bm25(queries, docs, boosts, 7)
    got = lambda: [(a, b, pytest.approx(c, abs=2e-6), d) for a, b, c, d in sorted(map(tuple, search(asked, index, 7, boosts).collect()))]
    assert got() == expected
    monkeypatch.setattr("linkwell.operators.retrieval.BLOCK_TERMS", 50)
    monkeypatch.setattr("linkwell.operators.retrieval.CELLS", 100)
    assert got() == expected
    assert search(asked.limit(0), index).count() == 0 and bm25_topk(asked, df.limit(0).select("id", F.col("name").alias("terms"))).count() == 0


def test_term_counts(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (None,)], "t array<string>")
    assert [None if r.c is None else [tuple(x) for x in r.c] for r in rows.select(term_counts(F.col("t")).alias("c")).collect()] == [[("a", 1), ("b", 2)], [], [("x", 1)], []]


def test_shared_runs(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(5, words[3:20]), (2, words[10:]), (9, words[:7])], "id long, terms array<string>")
    asked = spark.createDataFrame([(1, words[9:18]), (2, words[2:9]), (3, words[20:])], "qid long, terms array<string>")
    assert sorted(map(tuple, shared_run_truth(asked, docs).collect())) == [(1, 2), (3, 2)]


def test_appending_records_and_options(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4, 5], True, False), (2, [6], True, True), (3, [7], False, False)], "id long, terms array<int>, train boolean, vali boolean")
    path = str(tmp_path / "t")
    assert tables.read_features(spark, path) is None
    for _ in range(2):
        tables.append_rows(df, path, ["id", "terms"])
    assert tables.read_features(spark, path).count() == 6
    with pytest.raises(ValueError, match="holds"):
        tables.append_rows(df, path, ["id"])
    tables.write_records(df, str(tmp_path / "r"), ["id", "terms"])
    assert [tuple(tables.read_records(spark, str(tmp_path / "r"), s, {"terms": 2}).first()) for s in ("train", "vali", "test")] == [(1, [3, 4]), (2, [6, 0]), (3, [7, 0])]
    assert Options.parse(["--candidates", "20", "--tfidf", "false"]) == Options(candidates=20, tfidf=False)


def test_documents_scored_at_once(monkeypatch):
    import numpy as np

    from linkwell.operators import retrieval

    monkeypatch.setattr(retrieval, "CELLS", 10)
    assert list(retrieval._steps(np.array([4.0, 4, 4, 30, 1, 1, 8, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]


def test_shared_runs_sent_and_joined(spark, monkeypatch):
    asked = spark.createDataFrame([(1, list("abcdefgh")), (2, list("abc")), (3, list("xbcdefghi")), (4, None), (5, list("hgfedcba"))], "qid long, terms array<string>")
    docs = spark.createDataFrame([(9, list("zabcdefgh")), (7, list("bcdefghi")), (8, list("abcdefgh")), (6, list("hgfedcb")), (5, None)], "id long, terms array<string>")
    for most in (100, 0):
        monkeypatch.setattr("linkwell.operators.retrieval.SENT_RUNS", most)
        assert sorted(map(tuple, shared_run_truth(asked, docs).collect())) == [(1, 8), (3, 7)]
