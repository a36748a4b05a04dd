"""The pipeline and the registered queries of the subpackage."""

import glob
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwell.llm import queries, toxicity
from tests.llm.test_similar import brute_components, brute_fingerprint
from tests.test_queries import ordered

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DIR)
    theirs = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert ordered(df.columns, df.collect()) == ordered(names, theirs.fetchall())


def test_stages_against_brute_force(spark):
    read = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "x " * 50000, "en", "new", 100000)], read.schema)
    docs = read.unionByName(odd)
    key = lambda d: sorted((r.doc_id, r.text or "") for r in d.collect())

    model = queries.toxicity_model(spark, DIR)
    clean = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    scorer = toxicity.Model(model.weights, model.settings)
    expected = [(r.doc_id, r.text or "") for r in docs.collect() if scorer.score(r.text or "")[0] < 0.7]
    assert key(clean) == sorted(expected) and len(expected) > 0.8 * docs.count()

    single = corpus_pipeline.drop_exact_copies(spark, clean, DIR)
    best = {}
    for i, t in expected:
        best[t] = max(best.get(t, i), i)
    assert key(single) == sorted((i, t) for t, i in best.items())

    rows = sorted((i, t) for t, i in best.items())
    near = corpus_pipeline.drop_near_copies(spark, single, DIR)
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    assert key(near) == rows

    mixed = corpus_pipeline.mix_sources(spark, near, DIR)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    copies = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert copies.where("n > 2").isEmpty()
    size = lambda d: d.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert abs(size(mixed) - 1.5 * size(near)) < 0.1 * size(near)

    library = __import__("linkwell.llm.sentencepiece_codec", fromlist=["Codec"]).Codec(queries.tokenizer_model()).library
    texts = dict(rows)
    coded = corpus_pipeline.encode(spark, mixed, DIR).collect()
    assert len(coded) == mixed.count()
    for r in coded:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run(spark):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, DIR).count() > 50


ODD = [
    (1, "one good text of some words", "en", "s1", 27), (1, "one good text of some words", "en", "s1", 27), (2, None, None, None, None), (2, "", "en", "s1", 0), (None, "a text without an id", "de", None, None),
    (3, "one good text of some words", None, "s2", 27), (4, "Ein ganz anderer Satz steht hier", "de", "s2", 32)]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, stage):
    """Nulls, repeated rows, extra columns with names that stages use themselves, and no rows at all."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.withColumns({c: F.lit("x") for c in ("_id", "_sha", "sha", "fp", "root", "score", "predicted", "_copies", "_size", "kept", "keep_id", "component_id", "n_tokens")})
    got, plain = (stage(spark, d, DIR) for d in (clashing, docs))
    row = lambda df: sorted(map(repr, df.select("doc_id", *[c for c in df.columns if c in (corpus_pipeline.COLUMNS if df.columns == list(corpus_pipeline.COLUMNS) else ("n_tokens", "ids_sha256"))]).collect()))
    assert row(got) == row(plain) and (stage is not corpus_pipeline.drop_toxic or len(row(plain)) == len(ODD))
    assert stage(spark, docs.limit(0), DIR).collect() == []
    if stage is corpus_pipeline.drop_exact_copies:
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == [(False, 2, ""), (False, 3, "one good text of some words"), (False, 4, "Ein ganz anderer Satz steht hier"), (True, 0, "a text without an id")]
