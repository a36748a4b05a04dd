"""Labelled candidate samples, retrieval positions, and splits by organisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.operators.joins import null_safe
from linkwell.operators.scale import running, with_one

KEY = ["qid", "synid"]


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, synid, fid, score, ix) and (qid, true_id) to samples: qid, synid, fid, score, target, existing, ix.

    Scores become shares of their query's sum.  If a query's true id is not among its candidates, the
    row at ix 0 is replaced by the true id with score 0, target 1 and ix -1; the other shares stay.
    """
    joined = candidates.join(truth.select(F.col("qid").alias("_q"), "true_id"), F.col("qid") == F.col("_q"), "left").drop("_q")
    part = Window.partitionBy(*KEY)
    target = F.coalesce((F.col("fid") == F.col("true_id")).cast("int"), F.lit(0))
    rows = joined.withColumn("target", target).withColumns(
        {"score": F.try_divide(F.col("score"), F.sum("score").over(part)), "existing": F.col("true_id").isNotNull(), "_found": F.max("target").over(part)})
    missed = F.col("existing") & (F.col("_found") == 0) & (F.col("ix") == 0)
    return rows.select(
        *KEY, F.when(missed, F.col("true_id")).otherwise(F.col("fid")).alias("fid"), F.when(missed, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(missed, F.lit(1)).otherwise(F.col("target")).alias("target"), "existing", F.when(missed, F.lit(-1)).otherwise(F.col("ix")).alias("ix"))


def positions(queries: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(et_id, synid, el_id, i) of each query with a true id: the first hit's place, -1 if nothing was returned, -2 if it was missed."""
    asked = queries.select(*KEY).join(truth, "qid")
    hits = candidates.join(truth.withColumnRenamed("qid", "_q"), F.col("qid") == F.col("_q"))
    first = hits.groupBy(*KEY).agg(F.min(F.when(F.col("fid") == F.col("true_id"), F.col("ix"))).alias("_ix"), F.count(F.lit(1)).alias("_n"))
    i = F.when(F.col("_ix").isNotNull(), F.col("_ix")).when(F.coalesce("_n", F.lit(0)) == 0, F.lit(-1)).otherwise(F.lit(-2))
    return null_safe(asked, first, KEY, "left").select(F.col("qid").alias("et_id"), "synid", F.col("true_id").alias("el_id"), i.cast("int").alias("i"))


def barcode_positions(queries: DataFrame, candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """(et_id, synid, el_id, i) of queries (qid, synid, barcodes, src_id): the first candidate that shares a barcode.

    ``candidates``: qid, synid, fid, ix; ``codes``: fid, barcodes; both hold arrays of numbers.  A query without candidates has
    a null el_id and place -1; one whose candidates share no barcode has its own ``src_id`` and place -2.
    """
    each = candidates.join(codes, "fid").select(F.col("qid").alias("_q"), F.col("synid").alias("_s"), "fid", "ix", F.col("barcodes").alias("_codes"))
    met = queries.join(each, (F.col("qid") == F.col("_q")) & F.col("synid").eqNullSafe(F.col("_s")), "left")
    hit = F.arrays_overlap("barcodes", "_codes")
    best = met.groupBy(*KEY, "src_id").agg(F.min(F.when(hit, F.struct("ix", "fid"))).alias("_hit"), F.count("fid").alias("_n"))
    found, none = F.col("_hit").isNotNull(), F.col("_n") == 0
    return best.select(
        F.col("qid").alias("et_id"), "synid", F.when(found, F.col("_hit.fid")).when(~none, F.col("src_id")).alias("el_id"),
        F.when(found, F.col("_hit.ix")).when(none, -1).otherwise(-2).cast("int").alias("i"))


def shuffled(df: DataFrame, key: Column, seed: str, out: str = "place") -> DataFrame:
    """All rows with their place, from 1, in the order of a hash of seed and key; numbered by range partitions."""
    order = F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))
    return running(df, [order, key], {out: F.lit(1).cast("long")})


def balanced(matched: DataFrame, rest: DataFrame, key: str, seed: str) -> DataFrame:
    """All matched rows and as many of the rest, by a seeded hash; ``matched`` says which."""
    number = matched.agg(F.count(F.lit(1)).alias("_number"))
    drawn = with_one(shuffled(rest, F.col(key), seed, "_place"), number).where("_place <= _number").drop("_place", "_number")
    return matched.withColumn("matched", F.lit(True)).unionByName(drawn.withColumn("matched", F.lit(False)))


def seeded_sample(df: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: the same rows in every run."""
    return df.withColumn("_order", F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))).orderBy("_order").limit(n).drop("_order")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def org_split(samples: DataFrame, org: str, share: float = 0.1, seed: str = "split") -> DataFrame:
    """(org, n, test): whole organisations go to test or train, class by class of equal row numbers.

    A class of several organisations is split by their hashes.  Organisations that are alone in their
    class are taken in the order of size: one goes to test if the running test share then stays at
    most ``share``, else to train; the first goes to train.  That decision is sequential, in one pass over the
    class sizes: m rows need at least m (m + 1) / 2 samples, so the table stays far smaller than its input.
    """
    sizes = samples.groupBy(org).agg(F.count(F.lit(1)).alias("n"))
    peers = Window.partitionBy("n")
    ranked = sizes.withColumns({"peers": F.count(F.lit(1)).over(peers), "place": F.row_number().over(peers.orderBy(unit_hash(F.col(org), seed), org))})
    several = ranked.where("peers > 1").select(org, "n", (F.col("place") <= F.ceil(F.col("peers") * share)).alias("test"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested = total = 0
        for batch in batches:
            chosen = []
            for n in batch.column(1).to_pylist():
                chosen.append(total > 0 and tested + n <= share * (total + n))
                tested, total = tested + n * chosen[-1], total + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.bool_())], [*batch.schema.names, "test"])

    alone = ranked.where("peers = 1").select(org, "n").repartition(1).sortWithinPartitions("n").mapInArrow(decide, f"`{org}` {dict(samples.dtypes)[org]}, n long, test boolean")
    return several.unionByName(alone)


def nested_split(samples: DataFrame, org: str, share: float = 0.1) -> DataFrame:
    """Samples with ``train`` and ``vali``: test organisations first, then validation ones among the rest (they keep train).

    Rows without an organisation form an organisation of their own.
    """
    flagged = lambda rows, seed, flag: org_split(rows, org, share, seed).where("test").select(F.col(org).alias(f"{flag}_org"), F.lit(True).alias(flag))
    test = flagged(samples, "test", "_test")
    rest = samples.join(test, F.col(org).eqNullSafe(F.col("_test_org")), "left_anti")
    vali = flagged(rest, "vali", "_vali")
    out = samples.join(test, F.col(org).eqNullSafe(F.col("_test_org")), "left").join(vali, F.col(org).eqNullSafe(F.col("_vali_org")), "left")
    return out.withColumns({"train": F.col("_test").isNull(), "vali": F.col("_vali").isNotNull()}).drop("_test", "_vali", "_test_org", "_vali_org")


def parts(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows; without a ``train`` column all rows are test."""
    if "train" not in samples.columns:
        return samples.limit(0), samples.limit(0), samples
    return samples.where("train AND NOT vali"), samples.where("vali"), samples.where("NOT train")
