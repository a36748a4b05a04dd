"""Running sums and joins that no single task has to carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.storage import materialize

#: Keys that hold more than this share of the rows are joined by broadcast; there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) of columns over the whole table in the given order.

    Rows are range-partitioned and summed inside their partition; only one row for each partition is summed in one
    task.  Rows that the order holds equal are taken in any order, so the order should name a key.
    """
    parted = materialize(df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    totals = parted.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(F.broadcast(starts), "_part")
    return summed.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` beside the columns of a frame of one row."""
    return df.join(F.broadcast(one))


def skewed_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are unique and not null; ``rows`` of it counts the key's rows in ``left``.

    Keys with more than a thousandth of all rows are fewer than a thousand, so these are broadcast and no task gets all
    rows of one; the others are joined by shuffle.  With ``how`` left, rows without a partner stay.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) > total * HOT_SHARE).drop(rows)
    cold = right.where(F.col(rows) <= total * HOT_SHARE).drop(rows)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))
