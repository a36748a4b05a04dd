"""Evaluation: ranking gains, classifier reports, curves, abstention.

Rows are ranked by score descending, ties by id.  Divisions without a denominator give null, but for
precision, which is 1 when nothing is output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.operators.scale import running, with_one

def _ranked(df: DataFrame, group: list[str], score: str, tie: str, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie)))


def gain(rel: Column, place: Column, method: int = 1) -> Column:
    """rel / log2(place + 1); method 0 leaves the first undiscounted and divides the others by log2(place)."""
    if method == 1:
        return rel / F.log2(place + 1)
    return F.when(place == 1, rel.cast("double")).otherwise(rel / F.log2(F.greatest(place, F.lit(2))))


def ndcg(df: DataFrame, group: list[str], rel: str, score: str, tie: str, cuts: tuple[int, ...] = (1, 2, 5, 6, 7, 10), method: int = 1) -> DataFrame:
    """(group, k, dcg, ndcg): the ideal order is that of the whole list, cut at k; 0 if it gains nothing."""
    rows = _ranked(df, group, score, tie).withColumn("ideal", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(rel), tie)))
    cells = [f(F.when(F.col(p) <= k, gain(F.col(rel), F.col(p), method)).otherwise(0.0)).alias(f"{p}_{k}") for k in cuts for p, f in (("rn", F.sum), ("ideal", F.sum))]
    wide = rows.groupBy(*group).agg(*cells)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"rn_{k}").alias("dcg"), F.col(f"ideal_{k}").alias("ideal")) for k in cuts]))
    long = wide.select(*group, each.alias("c")).select(*group, "c.k", "c.dcg", "c.ideal")
    return long.select(*group, "k", "dcg", F.when(F.col("ideal") == 0, F.lit(0.0)).otherwise(F.try_divide("dcg", "ideal")).alias("ndcg"))


def mean_ndcg(per_group: DataFrame) -> DataFrame:
    return per_group.groupBy("k").agg(F.round(F.avg("ndcg"), 4).alias("ndcg"))


def first_relevant(df: DataFrame, group: list[str], rel: str, score: str, tie: str) -> DataFrame:
    """(group, pos): 0-based place of the first relevant row; null if there is none."""
    return _ranked(df, group, score, tie).groupBy(*group).agg((F.min(F.when(F.col(rel) > 0, F.col("rn"))) - 1).alias("pos"))


def average_relevant_place(df: DataFrame, group: list[str], rel: str, score: str, tie: str) -> DataFrame:
    """(group, arp): mean place weighted by relevance; null if nothing is relevant."""
    return _ranked(df, group, score, tie).groupBy(*group).agg(F.try_divide(F.sum(F.col("rn") * F.col(rel)).cast("double"), F.sum(rel).cast("double")).alias("arp"))


def ordered_pairs(df: DataFrame, group: list[str], rel: str, score: str, tie: str) -> DataFrame:
    """(group, pairs, correct): pairs of a positive and a negative row, and those ranked positive first.

    Counted with a running number of positives, so no pair is made.
    """
    before = F.sum(F.col(rel)).over(Window.partitionBy(*group).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_before", before)
    positive, negative = F.sum(rel), F.sum(1 - F.col(rel))
    return rows.groupBy(*group).agg((positive * negative).cast("long").alias("pairs"), F.sum(F.when(F.col(rel) == 0, F.col("_before")).otherwise(0)).cast("long").alias("correct"))


def recall_scale(samples: DataFrame) -> DataFrame:
    """One row: the share of positive samples whose true id was retrieved; null without positives."""
    found = F.avg(F.when(F.col("ix") != -1, 1.0).otherwise(0.0))
    return samples.where("target = 1").agg(found.alias("recall_scale"))


def recall_at(positions: DataFrame, scale: float = 1.0) -> DataFrame:
    """(n, share, recall): for each place that occurs, the share of queries found there, and up to there; misses count in the denominator."""
    counts = positions.groupBy("i").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    upto = F.sum("_c").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return counts.where("i >= 0").withColumn("_u", upto).join(F.broadcast(total)).select((F.col("i") + 1).alias("n"), (F.col("_c") / F.col("_t")).alias("share"), (F.col("_u") / F.col("_t") * scale).alias("recall"))


def report(df: DataFrame, label: str, prob: str, threshold: float = 0.4) -> DataFrame:
    """One row: precision, recall, f1 and support of class 1, share of class 0, accuracy; four decimals."""
    y, p = F.col(label), (F.col(prob) >= threshold).cast("int")
    n = lambda c: F.sum(c.cast("int")).cast("double")
    sums = df.agg(n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 1) & (p == 0)).alias("fn"), n((y == 0) & (p == 0)).alias("tn"))
    r4 = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        r4(tp, tp + fp).alias("precision"), r4(tp, tp + fn).alias("recall"), r4(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).cast("long").alias("support"),
        r4(tn + fp, tp + fp + fn + tn).alias("base_accuracy"), r4(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def confusion(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), (F.col(prob) >= threshold).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def pr_curve(df: DataFrame, label: str, prob: str) -> DataFrame:
    """(threshold, precision, recall), a row per distinct probability, with ``step``: the recall it adds.

    Rows are summed per probability first; the running sums then go over distinct values, by range partitions.
    """
    by = df.groupBy(F.col(prob).alias("threshold")).agg(F.sum(label).cast("long").alias("_p"), F.count(F.lit(1)).alias("_n"))
    run = running(by, [F.desc("threshold")], {"_tp": F.col("_p"), "_out": F.col("_n")})
    run = with_one(run, run.agg(F.max("_tp").alias("_all")))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("_all").cast("double"))
    return run.select("threshold", (F.col("_tp") / F.col("_out")).alias("precision"), share("_tp").alias("recall"), share("_p").alias("step"))


def average_precision(curve: DataFrame) -> DataFrame:
    """One row: the sum of recall steps times precision."""
    return curve.agg(F.round(F.sum(F.col("step") * F.col("precision")), 6).alias("ap"))


def abstention_curve(df: DataFrame, group: list[str], target: str, prob: str, tie: str, topns: tuple[int, ...] = (1, 2, 3, 5, 10, 20), steps: int = 100, scale: DataFrame | None = None) -> DataFrame:
    """(topn, threshold, tp, fp, tn, fn, precision, recall, mean_precision) for thresholds 0, 1/steps ... 1.

    ``scale``: a frame of one value, the share of true matches that retrieval found; recall is multiplied by it.
    ``mean_precision`` is that of a topn over all thresholds.

    A group answers if its best probability reaches the threshold, and is right if a true row is among its topn.
    Groups are counted by the last threshold that they reach; the counts are summed along the thresholds.
    """
    rows = _ranked(df, group, prob, tie)
    hits = [F.max(F.when(F.col("rn") <= t, F.col(target)).otherwise(0)).alias(f"hit_{t}") for t in topns]
    each = rows.groupBy(*group).agg(F.max(prob).alias("pmax"), F.max(target).alias("has"), *hits)
    guess = F.floor(F.col("pmax") * steps)
    reach = F.when((guess + 1) / float(steps) <= F.col("pmax"), guess + 1).when(guess / float(steps) > F.col("pmax"), guess - 1).otherwise(guess)
    each = each.withColumn("_reach", F.least(F.greatest(reach, F.lit(-1)), F.lit(steps)))
    long = each.select("_reach", "has", F.explode(F.array(*[F.struct(F.lit(t).alias("topn"), F.col(f"hit_{t}").alias("hit")) for t in topns])).alias("c"))
    counts = long.groupBy(F.col("c.topn").alias("topn"), "_reach").agg(
        F.sum(((F.col("has") == 1) & (F.col("c.hit") == 1)).cast("long")).alias("_right"), F.sum(((F.col("has") == 1) & (F.col("c.hit") == 0)).cast("long")).alias("_wrong"), F.sum((F.col("has") == 0).cast("long")).alias("_none"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").alias("_reach")).join(df.sparkSession.createDataFrame([(t,) for t in topns], "topn int"))
    full = grid.join(counts, ["topn", "_reach"], "left").fillna(0)
    up = Window.partitionBy("topn").orderBy(F.desc("_reach")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("topn")
    out = full.select(
        "topn", "_reach", F.sum("_right").over(up).alias("tp"), (F.sum("_wrong").over(up) + F.sum("_none").over(up)).alias("fp"),
        (F.sum("_none").over(whole) - F.sum("_none").over(up)).alias("tn"),
        (F.sum(F.col("_right") + F.col("_wrong")).over(whole) - F.sum(F.col("_right") + F.col("_wrong")).over(up)).alias("fn"))
    ratio = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.where("_reach >= 0").select("topn", (F.col("_reach") / float(steps)).alias("threshold"), "tp", "fp", "tn", "fn", F.coalesce(ratio(tp, tp + fp), F.lit(1.0)).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    out = out.withColumn("mean_precision", F.avg("precision").over(whole))
    return out if scale is None else with_one(out, scale.toDF("_scale")).withColumn("recall", F.col("recall") * F.col("_scale")).drop("_scale")


def type_errors(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Negatives above .9 (type 1) and positives below .1 (type 2)."""
    kind = F.when((F.col(label) == 0) & (F.col(prob) > 0.9), 1).when((F.col(label) == 1) & (F.col(prob) < 0.1), 2)
    return df.withColumn("error_type", kind).where("error_type IS NOT NULL")


def histogram(df: DataFrame, by: str, prob: str, bins: int = 20) -> DataFrame:
    """(by, bin, n, density) over [0, 1]; the last bin holds 1."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(by)))


def match_share(df: DataFrame, group: list[str], target: str = "target") -> DataFrame:
    """One row: the share of groups that hold a match."""
    return df.groupBy(*group).agg(F.max(target).alias("_has")).agg(F.avg("_has").alias("share"))
