"""Grouped ranking data: which groups can teach a ranker, scaling, numbering, truncation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.operators.scale import running, skewed_join

INFO = ("qid", "synid", "fid", "target", "train", "vali")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INFO]


def mixed_groups(df: DataFrame, key: list[str], target: str = "target") -> DataFrame:
    """Rows of groups that have both target values."""
    both = df.groupBy(*key).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi")).where("_lo <> _hi").select(*key)
    return df.join(both, key, "left_semi")


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, learnt on ``fit_on``; a deviation of 0 counts as 1."""
    stats = (fit_on if fit_on is not None else df).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c).cast("double") - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def number_groups(df: DataFrame, keys: list[str], out: str = "group_no") -> DataFrame:
    """Rows with their group's number, from 1, in key order; distinct keys are numbered by range partitions."""
    numbers = running(df.select(*keys).distinct(), [F.col(k) for k in keys], {out: F.lit(1).cast("long")})
    numbers = numbers.select(*[F.col(k).alias(f"_k_{k}") for k in keys], out)
    on = reduce(and_, (df[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return df.join(numbers, on).drop(*[f"_k_{k}" for k in keys])


def truncate_lists(df: DataFrame, key: list[str], order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows of each list."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def letor_line(target: Column, group: Column, features: list[Column]) -> Column:
    """``target qid:group 1:v 2:v ...`` with every feature at six decimals."""
    pattern = "%d qid:%d" + "".join(f" {i}:%.6f" for i in range(1, len(features) + 1))
    return F.format_string(pattern, target.cast("long"), group, *[f.cast("double") for f in features])


def dealt_lists(df: DataFrame, group: str, features: list[str], size: int) -> DataFrame:
    """``df`` with ``_g``, the name of a list: a group of more than ``size`` rows is dealt by a hash into lists of about that many.

    Equal rows are dealt apart by their place in the table; null is a group.
    """
    keyed = df.withColumn("_n", F.to_json(F.struct(F.col(group).alias("k"))))
    sizes = keyed.groupBy("_n").agg(F.ceil(F.count(F.lit(1)) / size).alias("_m"), F.count(F.lit(1)).alias("_rows"))
    dealt = F.pmod(F.xxhash64(*features, F.monotonically_increasing_id()), F.col("_m"))
    return skewed_join(keyed, sizes, "_n", "_rows").withColumn("_g", F.concat_ws("/", "_n", dealt)).drop("_n", "_m")
