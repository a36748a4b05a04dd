"""Lookups, links and keyed scans: all are equi joins, null-safe where keys may be null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and bytes of their JSON text, up to which a frame is broadcast; beyond either a join shuffles.
DICTIONARY_ROWS, DICTIONARY_BYTES = 100_000, 32 << 20


def small(df: DataFrame, most: int = DICTIONARY_ROWS, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows and ``most_bytes`` bytes, which one job finds out."""
    size = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if size["n"] <= most and (size["b"] or 0) <= most_bytes else df


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the left side's key columns stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(and_, (left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys))
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def lookup_optional(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str) -> DataFrame:
    """``df`` with the looked-up name in lower case, '' where there is none."""
    d = small(names.select(F.col(name_key).alias("_k"), F.col(name).alias("_n")))
    return df.join(d, df[key] == F.col("_k"), "left").withColumn(out, F.coalesce(F.lower("_n"), F.lit(""))).drop("_k", "_n")


def lookup_required(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str) -> DataFrame:
    """``df`` with the looked-up name; a key without one raises when its row is read."""
    d = small(names.select(F.col(name_key).alias("_k"), F.col(name).alias("_n")))
    missing = F.raise_error(F.concat(F.lit(f"no {name} for {key} "), F.coalesce(df[key].cast("string"), F.lit("null")))).cast("string")
    return df.join(d, df[key] == F.col("_k"), "left").withColumn(out, F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(missing)).drop("_k", "_n")


def known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def unknown(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``keys``; rows with a null key stay."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def lookup_link(df: DataFrame, key: str, links: DataFrame, link_key: str, target: str, out: str) -> DataFrame:
    """``df`` with the linked id as ``out``, null where a row has no link; of several links of a key the smallest counts."""
    one = links.where(F.col(link_key).isNotNull()).groupBy(F.col(link_key).alias("_k")).agg(F.min(target).alias(out))
    return df.drop(out).join(one, df[key] == F.col("_k"), "left").drop("_k")


def unique_links(feed: DataFrame, master: DataFrame, feed_id: str, master_id: str, code: str) -> DataFrame:
    """(feed id, code, master id) of feed rows that share exactly one (code, master) with the master.

    Codes are exploded already.  A feed row with two joined rows is ambiguous and goes, even if both lead to one master row.
    The master is counted by code before the join, so a code that many rows share on both sides makes no pairs.
    """
    masters = master.groupBy(code).agg(F.count(F.lit(1)).alias("_n"), F.min(master_id).alias(master_id))
    joined = feed.select(feed_id, code).join(masters, code)
    once = joined.groupBy(feed_id).agg(F.sum("_n").alias("_n"), F.min(code).alias(code), F.min(master_id).alias(master_id))
    return once.where("_n = 1").drop("_n").select(feed_id, code, master_id)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, null keys being equal."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
