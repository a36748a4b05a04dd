"""Dumps of one JSON object in small splits, against the json module."""

import json
import random
import zipfile

import pytest

from linkwell.sources import dumps

NASTY = ['plain', 'a } b', '"quoted"', '{[', ']}', '\\', '\\"', 'end\\\\', 'ü日本', 'new\nline', '', '}}}}{{{{', '"}', '\\u007d', ': [ {', '","x":[{']


def database(rng, n):
    def record(i):
        return {"id": i, "name": rng.choice(NASTY) * rng.choice((1, 1, 30)), "deep": {"list": [{"x": rng.choice(NASTY)}, {}], "n": {"m": {"k": i}}}, "tags": rng.sample(NASTY, 2)}

    return {
        "version": '1 } "x": [{', "info": {"a": {"b": {"c": rng.choice(NASTY)}}, "list": [{"no": 1}]}, "etalons": [record(i) for i in range(n)], "none": [],
        "brands": [{"id": i, "name": rng.choice(NASTY)} for i in range(n // 2)], "ключ": [{"id": 1, "name": "х"}], "last": None}


def expected(db):
    return {k: sorted(json.dumps(r, sort_keys=True) for r in v) for k, v in db.items() if isinstance(v, list) and v}


def got(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.name, []).append(json.dumps(json.loads(r.record), sort_keys=True))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "700")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent, listed", [(None, False), (2, False), (None, True), (1, True)])
def test_records_across_splits(spark, tmp_path, small_splits, indent, listed):
    rng = random.Random(3)
    db = database(rng, 60)
    whole = {"Database": [db, database(rng, 7), {"etalons": [{"id": -1}]}] if listed else db}
    path = tmp_path / "dump.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=indent is None))
    pieces = dumps.text_pieces(spark, str(path))
    assert pieces.select("split").distinct().count() > 10
    found = got(dumps.records(pieces))
    if indent is None:  # names are kept as they are written
        assert {json.loads(f'"{k}"'): v for k, v in found.items()} == expected(db)
    else:
        assert found == expected(db)


def test_zip_and_schema(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "CHUNK", 300)
    monkeypatch.setattr(dumps, "SPLIT", 900)
    rng = random.Random(4)
    db = database(rng, 40)
    for name, content in (("a.zip", {"Database": {"brands": [{"id": 1}]}}), ("b.zip", {"Database": db})):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x.json", json.dumps(content, ensure_ascii=False))
    frames = dumps.read_dump(spark, f"{tmp_path}/*.zip", zipped=True)
    assert set(frames) == {"etalons", "brands", "ключ"} and frames["etalons"].count() == 40
    assert sorted((r._id, r.name) for r in frames["brands"].collect()) == sorted((b["id"], b["name"]) for b in db["brands"])
    assert {r._id: r.deep.n.m.k for r in frames["etalons"].collect()} == {i: i for i in range(40)}
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("Database struct<brands: array<struct<id: long, name: string>>, other: array<struct<id: long>>>")
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"Database": db}))
    typed = dumps.read_dump(spark, str(path), schema=schema)
    assert set(typed) == {"brands"} and typed["brands"].dtypes == [("_id", "bigint"), ("name", "string")] and typed["brands"].count() == 20


def test_dumps_without_records(spark, tmp_path):
    for i, text in enumerate(("{}", '{"Database": {}}', '{"Database": []}', '{"Database": {"a": [], "b": 1}}', "")):
        (tmp_path / f"{i}.json").write_text(text)
        assert dumps.read_dump(spark, str(tmp_path / f"{i}.json")) == {}
