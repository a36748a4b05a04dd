"""TF-IDF and embedding distances between the two sides of a pair, and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linkwell.batches import bounded
from linkwell.functions.text import without_stop_words
from linkwell.storage import materialize


#: Terms whose document frequencies are broadcast at once, 16 bytes each: the most frequent ones.
BROADCAST_TERMS = 2_000_000


def tfidf(docs: DataFrame, fit_on: DataFrame | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, terms) to (id, words, weights): unit rows of tf (ln((1 + N) / (1 + df)) + 1), statistics from ``fit_on``.

    Words are 64-bit hashes of terms, ascending.  Terms in ``stop`` and terms that ``fit_on`` lacks are left out, and so are rows
    of which nothing is left.  Terms are hashed once; up to two million document frequencies, the highest, are sent to the tasks,
    which count, weigh and scale inside the row.  Only the rarer terms, if there are more, meet their frequencies by a shuffle.
    """
    def hashed(rows: DataFrame) -> DataFrame:
        kept = without_stop_words(F.col("terms"), stop) if stop else F.col("terms")
        words = F.transform(F.coalesce(kept, F.array().cast("array<string>")), lambda t: F.xxhash64(t))
        return materialize(rows.select("id", words.alias("words"), F.monotonically_increasing_id().alias("_row")), "tfidf-words")

    rows = hashed(docs)
    base = rows if fit_on is None else hashed(fit_on)
    n = base.count()
    df = materialize(base.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "tfidf-frequencies")
    least = _least_sent(df)
    table = df.where(F.col("df") >= least).orderBy("word").toArrow()
    idf = lambda d: F.log((1 + F.lit(n)) / (1 + d)) + 1
    sent = docs.sparkSession.sparkContext.broadcast((table["word"].to_numpy(), np.log((1 + n) / (1 + table["df"].to_numpy())) + 1))
    kind = dict(rows.dtypes)["id"]

    def places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = sent.value[0]
        at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
        return at, known[at] == words if len(known) else np.zeros(len(words), bool)

    def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.lexsort((word, row))
        word, row = word[order], row[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][: len(word)])
        return word[first], row[first], np.diff(np.r_[first, len(word)])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, row, _ = counted(batch.column(1))
            _, held = places(word)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[~held])), pa.array(word[~held])], ["_row", "word"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, row, tf = counted(batch.column(1))
            at, held = places(word)
            each = np.full(len(word), np.nan)
            each[held] = sent.value[1][at[held]]
            if batch.num_columns > 2:
                found = batch.column(2).flatten()
                fitted = np.repeat(np.arange(len(batch)), pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False))
                # a rare term stands next to its own entry once both are sorted together
                ours = np.flatnonzero(~held)
                r, w = np.r_[row[ours], fitted], np.r_[word[ours], found.field("word").to_numpy()]
                order = np.lexsort((np.r_[np.zeros(len(ours)), np.ones(len(fitted))], w, r))
                r, w = r[order], w[order]
                same = np.flatnonzero((r[1:] == r[:-1]) & (w[1:] == w[:-1]))
                each[ours[order[same]]] = found.field("idf").to_numpy()[order[same + 1] - len(ours)]
                held = ~np.isnan(each)
            word, row, weight = word[held], row[held], tf[held] * each[held]
            size = np.bincount(row, minlength=len(batch))
            weight /= np.sqrt(np.bincount(row, weight**2, len(batch)))[row]
            some = np.flatnonzero(size)
            offsets = pa.array(np.r_[0, np.cumsum(size[some])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(word)), pa.ListArray.from_arrays(offsets, pa.array(weight))], ["id", "words", "weights"])

    parts = bounded(rows).select("id", "words")
    if least > 1:
        rare = rows.select("_row", "words").mapInArrow(rest, "_row long, word long").join(df.where(F.col("df") < least), "word")
        lists = rare.groupBy("_row").agg(F.collect_list(F.struct("word", idf(F.col("df")).alias("idf"))).alias("rare"))
        parts = rows.join(lists, "_row", "left").select("id", "words", "rare")
    return materialize(parts.mapInArrow(weigh, f"id {kind}, words array<bigint>, weights array<double>"), "tfidf")


def _least_sent(df: DataFrame) -> int:
    """The least power of two from which on there are at most ``BROADCAST_TERMS`` document frequencies."""
    sizes = {r["k"]: r["n"] for r in df.groupBy((F.length(F.bin("df")) - 1).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least and held + sizes.get(least - 1, 0) <= BROADCAST_TERMS:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least


@F.pandas_udf(DoubleType())
def sparse_dot(words: pd.Series, weights: pd.Series, others: pd.Series, other_weights: pd.Series) -> pd.Series:
    """Sum over common words of the products of their weights; 0 where a side is null.  Words ascend."""
    out = np.zeros(len(words))
    for i, (a, x, b, y) in enumerate(zip(words, weights, others, other_weights, strict=True)):
        if a is not None and b is not None and len(a) and len(b):
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            hit = b[at] == a
            out[i] = x[hit] @ y[at[hit]]
    return pd.Series(out)


def paired_distance(pairs: DataFrame, weights: DataFrame, q: str = "q", d: str = "d") -> DataFrame:
    """``pairs`` with ``distance`` = half the squared distance of the unit rows: 1 - dot, .5 if one side is empty, 0 if both are."""
    x = weights.select(F.col("id").alias("_q"), F.col("words").alias("_x"), F.col("weights").alias("_xw"))
    y = weights.select(F.col("id").alias("_d"), F.col("words").alias("_y"), F.col("weights").alias("_yw"))
    both = pairs.join(x, F.col(q) == F.col("_q"), "left").join(y, F.col(d) == F.col("_d"), "left")
    size = F.col("_q").isNotNull().cast("double") + F.col("_d").isNotNull().cast("double")
    return both.withColumn("_dot", sparse_dot("_x", "_xw", "_y", "_yw")).select(*pairs.columns, (size / 2 - F.col("_dot")).alias("distance"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vector(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): position by position, so no group is collected."""
    one = vectors.select(key, F.posexplode(vector).alias("_i", "_x"))
    means = one.groupBy(key, "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean"))


#: Of the means, and mean, median and deviation of the least distances.
DISTANCES = ("of_means", "mean_min", "median_min", "std_min")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in DISTANCES]))
def vector_set_distances(q: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Cosine distance of the mean vectors, and mean, median and population deviation of each left vector's least distance.

    Without vectors on a side the first is null and the others are -1.  A zero vector has distance 1 from all.
    """
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)

    out = []
    for a, b in zip(q, d, strict=True):
        if a is None or b is None or not len(a) or not len(b):
            out.append((None, -1.0, -1.0, -1.0))
            continue
        x, y = np.stack(a).astype(np.float64), np.stack(b).astype(np.float64)
        least = (1 - unit(x) @ unit(y).T).min(1)
        out.append((float(1 - unit(x.mean(0)) @ unit(y.mean(0))), float(least.mean()), float(np.median(least)), float(least.std())))
    return pd.DataFrame(out, columns=DISTANCES, dtype="float64")


def set_distances(q: Column, d: Column) -> dict[str, Column]:
    """The least distances of two arrays of vectors, one product of matrices for a row; -1 if a side is empty."""
    found = vector_set_distances(q, d)
    return {n: found[n] for n in DISTANCES[1:]}


#: Bytes of query vectors that are broadcast at once; similarities that a task holds at once.
QUERY_BYTES, CELLS = 32 << 20, 4_000_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """(q, rank, key, cosine): exact neighbours of the query vectors among all rows but themselves, by rounded cosine, then by key.

    Query vectors are broadcast, at most ``most`` rows and 32 MB at once, and multiplied with the vectors batch by batch;
    each task keeps the best ``k`` of every query.  More queries are searched in blocks by a hash of their key, whose
    results are kept in scratch tables.  A zero vector has no cosine and comes last; null vectors take no part.
    """
    queries, vectors = (x.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()) for x in (queries, vectors))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("cells")).first()
    blocks = max(1, -(-size["n"] // most), -(-8 * size["cells"] // QUERY_BYTES))
    if blocks == 1:
        found = _nearest(queries, vectors, k, key, vector)
    else:
        block = lambda b: queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        found = reduce(DataFrame.unionByName, [materialize(_nearest(block(b), vectors, k, key, vector), "nearest") for b in range(blocks)])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("cosine"), key))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a list column; rows of zeros become NaN."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.full(x.shape, np.nan), where=size > 0)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(q, key, cosine): each task's best ``k`` of every query."""
    asked, kind = queries.toArrow(), dict(queries.dtypes)[key]
    schema = f"q {kind}, `{key}` {dict(vectors.dtypes)[key]}, cosine double"
    if not len(asked):
        return queries.sparkSession.createDataFrame([], schema)
    dim = max(1, len(asked[vector][0]))
    sent = queries.sparkSession.sparkContext.broadcast((asked[key].combine_chunks(), _unit(asked[vector].combine_chunks(), dim)))

    def names(column: pa.Array) -> np.ndarray:
        found = column.to_numpy(zero_copy_only=False)
        return found.astype(str) if found.dtype == object else found

    def best(q: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        order = np.lexsort((other, -np.nan_to_num(cosine, nan=-2.0), q))
        first = np.r_[True, q[order][1:] != q[order][:-1]][: len(order)]
        starts = np.flatnonzero(first)
        return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit = sent.value
        own_names, held, step = names(own), None, max(1, CELLS // len(own))
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                other = names(part.column(0))
                cosine = np.round(_unit(part.column(1), dim) @ unit.T, 6)
                free = other[:, None] != own_names[None, :]
                if len(part) > k:  # the k-th best of the part bounds what can stay
                    rank = np.where(free, np.nan_to_num(cosine, nan=-2.0), -3.0)
                    free &= rank >= np.partition(rank, len(part) - k, 0)[len(part) - k]
                d, q = np.nonzero(free)
                new = (q, other[d], cosine[d, q])
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                held = tuple(x[keep] for keep in [best(*held)] for x in held)
        if held is not None:
            q, other, cosine = held
            yield pa.RecordBatch.from_arrays([own.take(pa.array(q)), pa.array(other.tolist() if other.dtype.kind == "U" else other), pa.array(cosine, from_pandas=True)], ["q", key, "cosine"])

    return vectors.mapInArrow(run, schema)
