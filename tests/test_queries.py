"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from linkwell.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def ordered(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    theirs = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.columns, df.collect()) == ordered(names, theirs.fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("name", ["tokenize_names", "number_boundary_split"])
def test_names_of_one_split_are_tokenised_by_many_tasks(spark, name):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert catalogue.QUERIES[name](spark, DIR).select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
