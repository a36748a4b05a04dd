"""A neural ranker: batch-normalised layers, dropout and the pairwise logistic loss, trained by synchronous steps.

A step is one job over one slice of the lists: every task computes the gradient of its lists with the parameters that
were broadcast, gradients are added up in two levels, and the driver, which holds the parameters alone, makes an Adagrad
step.  Lists are written once, by slice, so a step reads its slice only.  Batch statistics are those of a task's
chunk of lists, as in any data-parallel training; running averages serve scoring.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.operators.ranking import dealt_lists
from linkwell.storage import remove, scratch_path

#: Lists whose gradient a task computes at once; tasks from which on gradients are added up in two levels.
CHUNK, WIDE = 256, 64
EPSILON = 1e-3


@dataclass(frozen=True)
class Settings:
    """``slices``: parts of the lists, one for each step; ``list_size``: rows of a list at training."""

    hidden: tuple[int, ...] = (256, 128, 64)
    dropout: float = 0.5
    rate: float = 0.01
    list_size: int = 6
    steps: int = 500
    slices: int = 16
    momentum: float = 0.9
    seed: int = 1


Parameters = dict[str, np.ndarray]


def start(inputs: int, s: Settings) -> tuple[Parameters, Parameters]:
    """Parameters, and running means and variances of each normalised layer."""
    rng, widths = np.random.default_rng(s.seed), (inputs, *s.hidden)
    p: Parameters = {"g0": np.ones(inputs), "b0": np.zeros(inputs)}
    running = {"m0": np.zeros(inputs), "v0": np.ones(inputs)}
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False), 1):
        limit = math.sqrt(6 / (a + b))
        p |= {f"w{k}": rng.uniform(-limit, limit, (a, b)), f"g{k}": np.ones(b), f"b{k}": np.zeros(b)}
        running |= {f"m{k}": np.zeros(b), f"v{k}": np.ones(b)}
    limit = math.sqrt(6 / (widths[-1] + 1))
    return p | {"w": rng.uniform(-limit, limit, widths[-1]), "c": np.zeros(1)}, running


def scores(p: Parameters, running: Parameters, x: np.ndarray) -> np.ndarray:
    """Scores of rows with running statistics and without dropout."""
    norm = lambda v, k: (v - running[f"m{k}"]) / np.sqrt(running[f"v{k}"] + EPSILON) * p[f"g{k}"] + p[f"b{k}"]
    h, k = norm(x, 0), 1
    while f"w{k}" in p:
        h, k = np.maximum(norm(h @ p[f"w{k}"], k), 0), k + 1
    return h @ p["w"] + p["c"][0]


def pair_loss(score: np.ndarray, target: np.ndarray, group: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Sum of log(1 + exp(-(better - worse))) over the pairs of unequal targets of each list, its gradient, and the number of pairs.

    Rows of a list stand together.
    """
    loss, pull, pairs = 0.0, np.zeros(len(score)), 0
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    first = 0
    for end in ends:
        s, t = score[first:end], target[first:end]
        better = t[:, None] > t[None, :]
        if n := int(better.sum()):
            gap = s[:, None] - s[None, :]
            loss += float(np.logaddexp(0, -gap)[better].sum())
            part = np.where(better, -1 / (1 + np.exp(np.clip(gap, -50, 50))), 0)
            pull[first:end] = part.sum(1) - part.sum(0)
            pairs += n
        first = end
    return loss, pull, pairs


def gradient(p: Parameters, x: np.ndarray, target: np.ndarray, group: np.ndarray, dropout: float, rng: np.random.Generator) -> tuple[Parameters, Parameters, float, int]:
    """Gradient of the summed loss, batch statistics, the loss and its number of pairs."""
    held, stats = [], {}

    def norm(v: np.ndarray, k: int) -> np.ndarray:
        mean, var = v.mean(0), v.var(0)
        unit = (v - mean) / np.sqrt(var + EPSILON)
        stats[f"m{k}"], stats[f"v{k}"] = mean, var
        held.append((unit, np.sqrt(var + EPSILON)))
        return unit * p[f"g{k}"] + p[f"b{k}"]

    h, k, layers = norm(x, 0), 1, []
    while f"w{k}" in p:
        z = norm(h @ p[f"w{k}"], k)
        layers.append((h, z > 0))
        h, k = np.maximum(z, 0), k + 1
    keep = (rng.random(h.shape) >= dropout) / (1 - dropout) if dropout else np.ones(h.shape)
    top = h * keep
    loss, pull, pairs = pair_loss(top @ p["w"] + p["c"][0], target, group)
    g: Parameters = {"w": top.T @ pull, "c": np.array([pull.sum()])}
    back = np.outer(pull, p["w"]) * keep

    def denorm(back: np.ndarray, k: int) -> np.ndarray:
        unit, size = held[k]
        g[f"g{k}"], g[f"b{k}"] = (back * unit).sum(0), back.sum(0)
        back = back * p[f"g{k}"]
        return (back - back.mean(0) - unit * (back * unit).mean(0)) / size

    for k in range(len(layers), 0, -1):
        below, active = layers[k - 1]
        back = denorm(back * active, k)
        g[f"w{k}"] = below.T @ back
        back = back @ p[f"w{k}"].T
    denorm(back, 0)
    return g, stats, loss, pairs


def _packed(p: Parameters) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in sorted(p)])


def _unpacked(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            v = np.frombuffer(row)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


@dataclass(frozen=True)
class NeuralRanker:
    features: list[str]
    parameters: Parameters
    running: Parameters
    settings: Settings
    losses: tuple[float, ...] = ()  # mean loss of a pair at each step

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with a score; a missing feature counts as 0."""
        sent = df.sparkSession.sparkContext.broadcast((self.parameters, self.running))
        x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in self.features])
        width = len(self.features)

        @F.pandas_udf("double")
        def scored(rows: pd.Series) -> pd.Series:
            return pd.Series(scores(*sent.value, np.stack(rows.to_list()).reshape(-1, width)))

        return df.withColumn(out, scored(x))

    def save(self, path: str) -> None:
        held = {"features": self.features, "settings": asdict(self.settings), **{n: {k: v.tolist() for k, v in getattr(self, n).items()} for n in ("parameters", "running")}}
        SparkSession.active().createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> NeuralRanker:
        held = json.loads(SparkSession.active().read.text(path).first()["value"])
        arrays = ({k: np.array(v, float) for k, v in held[n].items()} for n in ("parameters", "running"))
        return cls(held["features"], *arrays, Settings(**held["settings"] | {"hidden": tuple(held["settings"]["hidden"])}))


def train(rows: DataFrame, group: str, features: list[str], target: str, settings: Settings = Settings()) -> NeuralRanker:
    """A ranker that learns to put the better rows of a list above the worse ones.

    Every row takes part: longer groups are dealt by a hash into lists of about ``list_size`` rows.  Groups in which all targets
    are equal, null targets among them, teach nothing.  Missing features count as 0.
    """
    s, spark = settings, rows.sparkSession
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features])
    lists = dealt_lists(rows.select(F.col(group).alias("_k"), F.col(target).cast("double").alias("_t"), *features).where("_t IS NOT NULL"), "_k", features, s.list_size)
    lists = lists.groupBy("_g").agg(F.collect_list(F.struct(F.col("_t").alias("t"), x.alias("x"))).alias("r"))  # about ``list_size`` rows
    lists = lists.where(F.array_min("r.t") < F.array_max("r.t")).select(F.col("r.t").alias("t"), F.flatten("r.x").alias("x"), F.pmod(F.xxhash64("_g"), F.lit(s.slices)).cast("int").alias("slice"))
    where = scratch_path(spark, "neural-lists")
    lists.write.partitionBy("slice").parquet(where)
    held = spark.read.schema("t array<double>, x array<double>, slice int").parquet(where)
    p, running = start(len(features), s)
    total, losses, width = {n: np.full(v.shape, 0.1) for n, v in p.items()}, [], len(features)
    tasks = spark.sparkContext.defaultParallelism

    for step in range(s.steps):
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for a in range(0, len(batch), CHUNK):
                    part = batch.slice(a, CHUNK)
                    t = part.column(0).flatten().to_numpy()
                    inputs = part.column(1).flatten().to_numpy().reshape(-1, width)
                    lengths = part.column(0).value_lengths().to_numpy()
                    rng = np.random.default_rng([s.seed, step, TaskContext.get().partitionId(), a])
                    g, stats, loss, pairs = gradient(sent.value, inputs, t, np.repeat(np.arange(len(part)), lengths), s.dropout, rng)
                    one = np.concatenate([_packed(g), _packed(stats) * len(t), [loss, pairs, len(t)]])
                    sums = one if sums is None else sums + one
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        sliced = held.where(F.col("slice") == step % s.slices).select("t", "x")
        parts = sliced.mapInArrow(run, "sums binary")
        if tasks > WIDE:
            parts = parts.repartition(math.isqrt(tasks)).mapInArrow(_added, "sums binary")
        found = [np.frombuffer(r["sums"]) for r in parts.collect()]
        sent.unpersist()
        if not found:
            continue
        sums = np.sum(found, 0)
        size = sum(v.size for v in p.values())
        loss, pairs, n = sums[-3:]
        g, stats = _unpacked(sums[:size] / max(pairs, 1), p), _unpacked(sums[size:-3] / n, running)
        losses.append(float(loss / max(pairs, 1)))
        for name in p:
            total[name] = total[name] + g[name] ** 2
            p = p | {name: p[name] - s.rate * g[name] / np.sqrt(total[name])}
        running = {k: s.momentum * v + (1 - s.momentum) * stats[k] for k, v in running.items()}
    remove(spark, where)
    return NeuralRanker(list(features), p, running, s, tuple(losses))
