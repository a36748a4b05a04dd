"""A pair classifier whose word vectors are trained through it: mean vectors of both sides, hidden layers, logistic loss.

The word table is a frame keyed by side and word.  In a step, every part of a slice meets the vectors of its own words
alone, computes the gradient of its rows, and returns a sum for the layers and one for each word; word gradients are added up
by word and update the table by a join, layer gradients come to the driver, which holds the layers.  Steps are Adagrad's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.operators.features import token_vectors
from linkwell.operators.subwords import _start
from linkwell.storage import discard, materialize, remove, scratch_path

#: Sides of a pair; the kind under which a part returns its layers' gradient.
Q, D, LAYERS = 0, 1, -1


@dataclass(frozen=True)
class Settings:
    """``slices``: parts of the rows, one for each step; ``part_rows``: rows whose gradient a task computes at once."""

    dim: int = 50
    hidden: tuple[int, ...] = (200, 100)
    dropout: float = 0.2
    rate: float = 0.1
    steps: int = 100
    slices: int = 4
    part_rows: int = 5000
    seed: int = 1


Layers = list[tuple[np.ndarray, np.ndarray]]


def first_layers(s: Settings) -> Layers:
    rng, widths = np.random.default_rng(s.seed), (2 * s.dim, *s.hidden, 1)
    return [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(widths, widths[1:], strict=False)]


def probabilities(layers: Layers, x: np.ndarray) -> np.ndarray:
    for w, c in layers[:-1]:
        x = np.maximum(x @ w + c, 0)
    w, c = layers[-1]
    return 1 / (1 + np.exp(-np.clip((x @ w + c)[:, 0], -50, 50)))


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, dropout: float, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Of the summed loss by layers (weights and constants in turn) and by inputs, and the loss."""
    inputs, keeps = [x], []
    for w, c in layers[:-1]:
        z = inputs[-1] @ w + c
        keep = (z > 0) * ((rng.random(z.shape) >= dropout) / (1 - dropout) if dropout else 1.0)
        keeps.append(keep)
        inputs.append(z * keep)
    w, c = layers[-1]
    logit = (inputs[-1] @ w + c)[:, 0]
    loss = float((np.logaddexp(0, logit) - y * logit).sum())
    back, out = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y)[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        out = [inputs[k].T @ back, back.sum(0), *out]
        back = back @ layers[k][0].T
        if k:
            back = back * keeps[k - 1]
    return out, back, loss


def _part(layers: Layers, s: Settings, step: int):
    def run(key: tuple, rows: pa.Table, words: pa.Table) -> pa.Table:
        names, held = {}, {}
        for side in (Q, D):
            mine = words.filter(pc.equal(words["side"], side))
            names[side] = {w: i for i, w in enumerate(mine["word"].to_pylist())}
            held[side] = _start(mine["hash"].to_numpy(), s.dim, s.seed + side) * s.dim**0.5 if len(mine) else np.zeros((0, s.dim))
            known = np.flatnonzero(pc.is_valid(mine["vector"]).to_numpy(zero_copy_only=False))
            if len(known):
                held[side][known] = np.stack(mine["vector"].combine_chunks().drop_null().to_numpy(zero_copy_only=False))
        y, n = rows["y"].to_numpy().astype(float), len(rows)
        x, at, row, share = np.zeros((n, 2 * s.dim)), {}, {}, {}
        for side, column in ((Q, "q"), (D, "d")):
            lists = [[names[side][w] for w in x if w in names[side]] for x in rows[column].to_pylist()]
            size = np.array([len(v) for v in lists])
            at[side], row[side] = np.array([i for v in lists for i in v], np.int64), np.repeat(np.arange(n), size)
            share[side] = 1 / np.maximum(size, 1)[row[side]]
            np.add.at(x[:, side * s.dim : (side + 1) * s.dim], row[side], held[side][at[side]] * share[side][:, None])
        layer_sums, back, loss = gradient(layers, x, y, s.dropout, np.random.default_rng([s.seed, step, key[0].as_py()]))
        kinds, texts, sums = [LAYERS], [""], [np.concatenate([*(g.ravel() for g in layer_sums), [loss, n]])]
        for side in (Q, D):
            total = np.zeros((len(names[side]), s.dim))
            np.add.at(total, at[side], back[row[side], side * s.dim : (side + 1) * s.dim] * share[side][:, None])
            for w, i in names[side].items():
                kinds.append(side)
                texts.append(w)
                sums.append(total[i])
        return pa.table({"side": pa.array(kinds, pa.int32()), "word": pa.array(texts), "sums": pa.array([v.tolist() for v in sums], pa.list_(pa.float64()))})

    return run


@dataclass(frozen=True)
class WordClassifier:
    settings: Settings
    layers: Layers
    table: DataFrame  # side, word, vector, squares
    losses: tuple[float, ...]

    def score(self, pairs: DataFrame, q: str = "q_terms", d: str = "d_terms", out: str = "prob") -> DataFrame:
        """``pairs`` with the probability of a match.  Words that training did not see are left out of a side's mean; a side without words counts as zeros."""
        rows = materialize(pairs.withColumn("_row", F.monotonically_increasing_id()), "wordnet-rows")
        side = lambda k, c: token_vectors(rows.select("_row", F.col(c).alias("tokens")), ["_row"], self.table.where(F.col("side") == k).select("word", "vector"))
        both = rows.join(side(Q, q).withColumnRenamed("vectors", "_q"), "_row").join(side(D, d).withColumnRenamed("vectors", "_d"), "_row")
        sent, dim = pairs.sparkSession.sparkContext.broadcast(self.layers), self.settings.dim

        @F.pandas_udf("double")
        def scored(a: pd.Series, b: pd.Series) -> pd.Series:
            mean = lambda v: np.mean(np.stack(v), 0) if v is not None and len(v) else np.zeros(dim)
            return pd.Series(probabilities(sent.value, np.concatenate([np.stack([mean(v) for v in side]) for side in (a, b)], 1)))

        return both.withColumn(out, scored("_q", "_d")).select(*pairs.columns, out)


def train(pairs: DataFrame, label: str, settings: Settings = Settings(), q: str = "q_terms", d: str = "d_terms") -> WordClassifier:
    """Fit on pairs of term arrays with a label of 0 or 1; rows with another label are left out, null arrays count as empty."""
    s, spark = settings, pairs.sparkSession
    none = F.array().cast("array<string>")
    rows = pairs.where(F.col(label).isin(0, 1)).select(F.coalesce(q, none).alias("q"), F.coalesce(d, none).alias("d"), F.col(label).cast("int").alias("y"))
    rows = materialize(rows.withColumn("i", F.xxhash64(F.monotonically_increasing_id())), "wordnet-pairs")
    parts = max(1, -(-rows.count() // (s.slices * s.part_rows)))
    where = scratch_path(spark, "wordnet-slices")
    rows.withColumns({"part": F.pmod(F.shiftright("i", 8), F.lit(parts)).cast("int"), "slice": F.pmod("i", F.lit(s.slices)).cast("int")}).drop("i").write.partitionBy("slice").parquet(where)
    held = spark.read.schema("q array<string>, d array<string>, y int, part int, slice int").parquet(where)
    layers, table, losses = first_layers(s), None, []
    squares = [np.full(g.shape, 0.1) for pair in layers for g in pair]
    for step in range(s.steps):
        now = held.where(F.col("slice") == step % s.slices).drop("slice")
        words = now.select(F.col("part").alias("at"), F.lit(Q).alias("side"), F.explode("q").alias("word")).unionByName(now.select(F.col("part").alias("at"), F.lit(D).alias("side"), F.explode("d").alias("word"))).where("word IS NOT NULL").distinct()
        words = words.withColumn("hash", F.xxhash64("word"))
        met = words.join(table.select("side", "word", "vector"), ["side", "word"], "left") if table is not None else words.withColumn("vector", F.lit(None).cast("array<double>"))
        found = now.groupBy("part").cogroup(met.groupBy("at")).applyInArrow(_part(layers, s, step), "side int, word string, sums array<double>")
        found = materialize(found, "wordnet-gradients")
        returned = [np.array(r["sums"]) for r in found.where(F.col("side") == LAYERS).select("sums").collect()]  # one for each part of the slice
        if not returned:
            continue
        total = np.sum(returned, 0)
        loss, n, at, new = float(total[-2]), float(total[-1]), 0, []
        losses.append(loss / n)
        for k, g in enumerate(g for pair in layers for g in pair):
            step_sum = total[at : at + g.size].reshape(g.shape) / n
            at += g.size
            squares[k] = squares[k] + step_sum**2
            new.append(g - s.rate * step_sum / np.sqrt(squares[k]))
        layers = list(zip(new[::2], new[1::2], strict=True))
        # a word's gradient counts by the rows that hold it, else rare words would hardly move
        sums = found.where(F.col("side") != LAYERS).groupBy("side", "word").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"_{i}") for i in range(s.dim)])
        sums = sums.select("side", "word", F.array(*[F.col(f"_{i}") for i in range(s.dim)]).alias("g"))
        old, table = table, materialize(_updated(table, sums, s), "wordnet-table")
        discard(found, *([old] if old is not None else []))
    remove(spark, where)
    if table is None:
        table = spark.createDataFrame([], "side int, word string, vector array<double>, squares array<double>")
    return WordClassifier(s, layers, table, tuple(losses))


def _updated(table: DataFrame | None, sums: DataFrame, s: Settings) -> DataFrame:
    """The word table after an Adagrad step; words that are new to it start from their hash."""
    first = _first_vectors(s)
    if table is None:
        both = sums.withColumns({"vector": F.lit(None).cast("array<double>"), "squares": F.lit(None).cast("array<double>")})
    else:
        both = table.join(sums, ["side", "word"], "full")
    vector = F.coalesce("vector", first(F.xxhash64("word"), F.col("side")))
    held = both.select("side", "word", vector.alias("vector"), F.coalesce("squares", F.array_repeat(F.lit(0.1), s.dim)).alias("squares"), F.coalesce("g", F.array_repeat(F.lit(0.0), s.dim)).alias("g"))
    held = held.withColumn("squares", F.zip_with("squares", "g", lambda a, g: a + g * g))
    moved = F.zip_with("vector", F.zip_with("g", "squares", lambda g, a: g / F.sqrt(a)), lambda v, m: v - s.rate * m)
    return held.select("side", "word", moved.alias("vector"), "squares")


def _first_vectors(s: Settings):
    @F.pandas_udf("array<double>")
    def first(keys: pd.Series, sides: pd.Series) -> pd.Series:
        out = np.zeros((len(keys), s.dim))
        for side in (Q, D):
            mine = (sides == side).to_numpy()
            out[mine] = _start(keys[mine].to_numpy(), s.dim, s.seed + side) * s.dim**0.5
        return pd.Series(list(out))

    return first
