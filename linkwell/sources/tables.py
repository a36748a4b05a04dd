"""Ranking text with its side files, and the delimited tables of the evaluation.

A ranking file is written by range partitions of the group number, so part files in name order hold
the groups in order, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.operators.ranking import letor_line, number_groups
from linkwell.operators.sampling import parts
from linkwell.sources import records


def write_ranking(df: DataFrame, path: str, keys: list[str], target: str, features: list[str], order: list[str]) -> None:
    """``path``.txt (target qid:n 1:v ...), ``path``.group (rows per group), ``path``.ix (ids, tab-separated)."""
    rows = number_groups(df, keys, "_no").repartitionByRange("_no").sortWithinPartitions("_no", *order)
    rows.select(letor_line(F.col(target), F.col("_no"), [F.col(f) for f in features]).alias("value")).write.mode("overwrite").text(f"{path}.txt")
    rows.select(*keys, *order, target).write.mode("overwrite").option("sep", "\t").csv(f"{path}.ix")
    sizes = rows.groupBy("_no").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("_no").sortWithinPartitions("_no")
    sizes.select(F.col("n").cast("string").alias("value")).write.mode("overwrite").text(f"{path}.group")


def read_ranking(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """(target, qid, f1 ...) of ranking text; what follows # is a comment; a line without two tokens raises."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    tokens = F.split(line, r"\s+")
    rows = spark.read.text(path).where(line != "").withColumn("t", tokens)
    checked = F.when(F.size("t") >= 2, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("not a ranking line: "), "value")).cast("array<string>"))
    rows = rows.withColumn("t", checked)
    values = F.map_from_entries(F.transform(F.slice("t", 3, 1 << 20), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("k"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double").alias("v"))))
    rows = rows.withColumn("m", values)
    return rows.select(F.get("t", 0).cast("double").cast("int").alias("target"), F.split_part(F.get("t", 1), F.lit(":"), F.lit(2)).cast("long").alias("qid"), *[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)).alias(f"f{i}") for i in range(1, n_features + 1)])


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("int").alias("n"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("qid long, synid long, fid long, target int").csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """id, label, left_name, right_name with a header, quoted only where needed."""
    pairs.select("id", "label", "left_name", "right_name").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prob) of a matcher's output."""
    return spark.read.option("header", True).schema("id long, match_score double").csv(path).withColumnRenamed("match_score", "prob")


def write_table(df: DataFrame, path: str, tab: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


def padded(df: DataFrame, column: str, size: int, fill) -> DataFrame:
    """The array column cut or filled to ``size``."""
    missing = F.greatest(F.lit(size) - F.size(column), F.lit(0))
    return df.withColumn(column, F.slice(F.concat(F.col(column), F.array_repeat(F.lit(fill), missing)), 1, size))


def append_rows(df: DataFrame, path: str, columns: list[str]) -> None:
    """Add rows of named columns to a table; a table that has other columns raises."""
    spark, rows = df.sparkSession, df.select(*columns)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.parquet(path).dtypes
        if held != rows.dtypes:
            raise ValueError(f"{path} holds {held}, not {rows.dtypes}")
    rows.write.mode("append").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame | None:
    """The feature table at ``path``, or None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def write_records(samples: DataFrame, path: str, columns: list[str], files: int = 1, framed: bool = False) -> None:
    """``path``/train, vali and test, as record files of the named columns (terms, term ids or vectors); see ``sampling.parts``.

    The files are Parquet or, if ``framed``, check-summed records; see ``records``.
    """
    for name, part in zip(("train", "vali", "test"), parts(samples), strict=True):
        rows = part.select(*columns).repartition(files)
        if framed:
            records.write(rows, f"{path}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_records(spark: SparkSession, path: str, split: str, terms: dict[str, int] | None = None, fill=0, framed: bool = False) -> DataFrame:
    """The records of one split, whose array columns in ``terms`` are cut or filled to a size."""
    rows = records.read(spark, f"{path}/{split}") if framed else spark.read.parquet(f"{path}/{split}")
    for column, size in (terms or {}).items():
        rows = padded(rows, column, size, fill)
    return rows
