"""Record files: round trips, damage, failed writes."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from linkwell.sources import records, tables

SCHEMA = "id long, terms array<string>, vector array<double>, s struct<a: int, b: array<string>>, ok boolean, x double"
ROWS = [(1, ["a", "ü", None], [0.1, 1 / 3, -1e300], (1, ["x"]), True, 0.1 + 0.2), (2, [], [], (None, []), None, None), (None, None, None, None, False, -0.0), (3, ["long " * 50000], [1.0], (2, None), True, 5e-324)]


def same(df, rows):
    plain = lambda r: (r.id, r.terms, r.vector, tuple(r.s) if r.s else r.s, r.ok, r.x)
    assert sorted(map(repr, map(plain, df.collect()))) == sorted(map(repr, rows))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    records.write(df, path, file_bytes=200)
    got = records.read(spark, path)
    assert got.dtypes == df.dtypes and len(glob.glob(f"{path}/*/*.rec")) >= 3
    same(got, ROWS)
    records.write(df.where("id = 1"), path, "append")
    same(records.read(spark, path), [*ROWS, ROWS[0]])
    with pytest.raises(Exception, match="another schema"):
        records.write(spark.range(1), path, "append")
    records.write(df.where("id = 2"), path)
    same(records.read(spark, path), [ROWS[1]])
    assert len(glob.glob(f"{path}/data-*")) == 1
    records.write(df.limit(0), path)
    assert records.read(spark, path).count() == 0


@pytest.mark.parametrize("at", [3, 12, 18, 40, -2])
def test_damage_raises(spark, tmp_path, at):
    path = str(tmp_path / "r")
    records.write(spark.createDataFrame([(1, "some text of a record")], "id int, t string").coalesce(1), path)
    file = glob.glob(f"{path}/*/*.rec")[0]
    body = bytearray(open(file, "rb").read())
    body[at] ^= 1
    open(file, "wb").write(body)
    with pytest.raises(Exception, match="record"):
        records.read(spark, path).collect()
    open(file, "wb").write(body[:-1])  # cut short
    with pytest.raises(Exception, match="record"):
        records.read(spark, path).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    bad = spark.range(0, 2000, 1, 4).select("id", F.when(F.col("id") == 1900, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="stop"):
        records.write(bad, path)
    assert not os.path.exists(f"{path}/{records.MANIFEST}")
    with pytest.raises(Exception, match="no record files"):
        records.read(spark, path)
    good = spark.range(10).select("id", F.lit("y").alias("t"))
    records.write(good, path)
    with pytest.raises(Exception, match="stop"):
        records.write(bad, path)
    assert records.read(spark, path).count() == 10
    time.sleep(1)  # tasks that were still writing
    assert records.vacuum(path) == 0 and records.vacuum(path, 0) <= 2
    assert records.read(spark, path).count() == 10 and len(glob.glob(f"{path}/data-*")) == 1
    with pytest.raises(Exception, match="mount"):
        records.read(spark, "viewfs://store/x").collect()


def test_splits_as_framed_records(spark, tmp_path):
    rows = [(1, ["a", "b", "c"], True, False), (2, ["d"], True, True), (3, [], False, False)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, train boolean, vali boolean")
    tables.write_records(df, str(tmp_path), ["id", "terms"], 2, framed=True)
    got = {split: [(r.id, r.terms) for r in tables.read_records(spark, str(tmp_path), split, {"terms": 2}, "", framed=True).collect()] for split in ("train", "vali", "test")}
    assert got == {"train": [(1, ["a", "b"])], "vali": [(2, ["d", ""])], "test": [(3, ["", ""])]}
