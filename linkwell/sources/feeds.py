"""Catalogue dumps: JSON with a ``Database`` object (or a list whose first item counts) of named arrays."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: The dictionaries of a master dump (fixed values).
ENTITIES = ("etalons", "features", "categories", "featureValues", "brands", "subBrands", "goodTypes", "manufacturers", "suppliers", "units", "classifiers")


def read_feed(spark: SparkSession, path: str, schema: StructType | None = None) -> dict[str, DataFrame]:
    """A frame per non-empty array member of ``Database``, with ``id`` renamed to ``_id``; other members are skipped."""
    reader = spark.read.option("multiLine", True)
    raw = (reader.schema(schema) if schema else reader).json(path)
    return _entities(raw)


def _entities(raw: DataFrame) -> dict[str, DataFrame]:
    kind = raw.schema["Database"].dataType
    if isinstance(kind, ArrayType):
        raw, kind = raw.select(F.get("Database", 0).alias("Database")), kind.elementType
    out = {}
    for field in kind.fields:
        if isinstance(field.dataType, ArrayType):
            rows = raw.select(F.explode(f"Database.{field.name}").alias("_e"))
            rows = rows.select("_e.*") if isinstance(field.dataType.elementType, StructType) else rows.withColumnRenamed("_e", "value")
            if not rows.isEmpty():
                out[field.name] = rows.withColumnRenamed("id", "_id")
    return out


def read_zipped_feed(spark: SparkSession, path: str, schema: StructType) -> dict[str, DataFrame]:
    """As ``read_feed``, from the first member of the last zip file (by name) that the path matches."""
    files = spark.read.format("binaryFile").load(path)
    last = files.agg(F.max_by("content", "path").alias("content"))

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"].dropna():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"value": [json.dumps(json.loads(z.read(z.namelist()[0])), ensure_ascii=False)]})

    text = last.mapInPandas(unzip, "value string")
    return _entities(text.select(F.from_json("value", schema).alias("v")).select("v.*"))


def write_feed(entities: dict[str, DataFrame], folder: str) -> None:
    for name, rows in entities.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def dictionaries(entities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(id, name) of each known dictionary that the dump holds."""
    return {n: entities[n].select(F.col("_id").alias("id"), "name") for n in ENTITIES if n in entities and n != "etalons" and "name" in entities[n].columns}


#: What a dictionary's rows are found by, where it is not the id, and which column names a row, where it is not the name (fixed values).
FOUND_BY, NAMED_BY = {"units": "name", "classifiers": "name"}, {"featureValues": "value"}


def rows_by_key(entities: dict[str, DataFrame], name: str) -> DataFrame | None:
    """The whole rows of a dictionary with their ``key``: the id, or the name of units and classifiers; None if the dump lacks it.

    Rows without a key are left out; of several rows of a key one stays.
    """
    if name not in entities:
        return None
    rows = entities[name].withColumn("key", F.col(FOUND_BY.get(name, "_id")))
    return rows.where("key IS NOT NULL").dropDuplicates(["key"])


def ids_by_name(entities: dict[str, DataFrame], name: str) -> DataFrame | None:
    """(label, id) of a dictionary: names, or the values of feature values; of equal names the largest id counts."""
    label = NAMED_BY.get(name, "name")
    if name not in entities or name in FOUND_BY or label not in entities[name].columns:
        return None
    return entities[name].where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.max("_id").alias("id"))


def write_index(docs: DataFrame, path: str) -> None:
    """Search documents as JSON lines, letters kept as they are."""
    docs.write.mode("overwrite").json(path)
