"""Candidate retrieval: a stored index of term counts, BM25 over one or more fields, the best N per query.

The index has one row for each document, with the counts of its terms, made inside the row: nothing is
shuffled to build it but the document frequencies.  A query set is searched in blocks of bounded size: a block's
weights are broadcast, each task multiplies them with the term counts of its documents in Arrow batches and
keeps the best N per query, so neither postings nor pairs of queries and documents are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.batches import bounded
from linkwell.functions.text import bound
from linkwell.operators.joins import small
from linkwell.storage import materialize

K1, B = 1.2, 0.75
#: Query terms and queries of one block, which are collected and broadcast; scores, and gains that add up to them, that a task holds at once.
BLOCK_TERMS, BLOCK_QUERIES, CELLS = 1_000_000, 20_000, 1_000_000
#: Runs of the queries, 8 bytes each, up to which they are sent to every task.
SENT_RUNS = 4_000_000


def ascii_terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def term_counts(terms: Column) -> Column:
    """An array of terms as array<struct<term, tf>>, by term: equal terms stand together once they are sorted.  Null counts as empty."""
    def counted(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        return bound(F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))), lambda starts: runs(ordered, starts))

    def runs(ordered: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ordered)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).alias("tf")))

    # nothing is sorted or searched twice: what a lambda names is computed before it
    return F.when(F.size(terms) > 0, bound(F.sort_array(terms), counted)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def postings(docs: DataFrame) -> DataFrame:
    """(id, terms) to (id, term, tf, dl)."""
    return docs.select("id", F.size("terms").alias("dl"), F.explode(term_counts(F.col("terms"))).alias("c")).select("id", "c.term", "c.tf", "dl")


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Index:
    """``rows``: id and, for each field, dl_, terms_ and tfs_; ``frequencies``: field, term, df; ``totals``: documents and mean length by field."""

    rows: DataFrame
    frequencies: DataFrame
    totals: dict[str, tuple[int, float]]


def _frequencies(rows: DataFrame, fields: list[str]) -> DataFrame:
    each = [rows.select(F.lit(f).alias("field"), F.explode(f"terms_{f}").alias("term")) for f in fields]
    return reduce(DataFrame.unionByName, each).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def _opened(rows: DataFrame, frequencies: DataFrame, fields: list[str], count_empty: bool) -> Index:
    sums = rows.agg(*[x for f in fields for x in (F.count(F.lit(1) if count_empty else F.nullif(f"dl_{f}", F.lit(0))).alias(f"n_{f}"), F.sum(f"dl_{f}").alias(f"s_{f}"))]).first()
    return Index(rows, frequencies, {f: (sums[f"n_{f}"], (sums[f"s_{f}"] or 0) / sums[f"n_{f}"] if sums[f"n_{f}"] else 0.0) for f in fields})


def build_index(docs: DataFrame, fields: list[str] = ["terms"], path: str | None = None, count_empty: bool = True) -> Index:
    """An index of (id, one array of terms for each field).  Null arrays count as empty; ids are numbers and not null.

    With a ``path`` rows and frequencies are stored there for ``open_index``; else the rows lie in the scratch folder.
    ``count_empty``: whether documents without terms in a field count for its number of documents and mean length.
    """
    held = docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in fields])
    counts = held.select("id", *[x for f in fields for x in (F.size(f).alias(f"dl_{f}"), term_counts(F.col(f)).alias(f"_{f}"))])
    rows = counts.select("id", *[x for f in fields for x in (F.col(f"dl_{f}"), F.col(f"_{f}.term").alias(f"terms_{f}"), F.col(f"_{f}.tf").alias(f"tfs_{f}"))])
    if path is None:
        rows = materialize(rows, "index")
        return _opened(rows, _frequencies(rows, fields), fields, count_empty)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = docs.sparkSession.read.parquet(f"{path}/rows")
    _frequencies(stored, fields).write.mode("overwrite").parquet(f"{path}/frequencies")
    return open_index(docs.sparkSession, path, count_empty)


def open_index(spark: SparkSession, path: str, count_empty: bool = True) -> Index:
    rows = spark.read.parquet(f"{path}/rows")
    return _opened(rows, spark.read.parquet(f"{path}/frequencies"), [c[3:] for c in rows.columns if c.startswith("dl_")], count_empty)


def search(queries: DataFrame, index: Index, n: int = 20, boosts: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, terms) against an index: qid, fid, score (6 decimals), ix (from 0), best n per query.

    A field's score is the sum over the query's terms of idf tf / (tf + k1 (1 - b + b dl / mean)), with idf =
    ln(1 + (N - df + .5) / (df + .5)); terms that a query repeats count as often.  Fields add up, each times its
    boost (1 for all by default).  Only documents that hold a term are found.  Ties go to the smaller id.
    """
    asked = materialize(queries.select("qid", F.explode("terms").alias("term")).where("term IS NOT NULL").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("qid").alias("queries")).first()
    blocks = max(-(-size["terms"] // BLOCK_TERMS), -(-size["queries"] // BLOCK_QUERIES))
    if not blocks:
        return queries.sparkSession.createDataFrame([], f"qid {dict(asked.dtypes)['qid']}, fid long, score double, ix int")
    parts = [asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else asked for i in range(blocks)]
    boosts = boosts or dict.fromkeys(index.totals, 1.0)
    found = [_search_block(p, index, n, boosts, k1, b) for p in parts]
    if blocks > 1:
        found = [materialize(f, "found") for f in found]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "fid"))
    return reduce(DataFrame.unionByName, found).withColumn("ix", place - 1).where(F.col("ix") < n)


def _steps(load: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents whose scores, and the gains that add up to them, are few enough to be held at once."""
    upto, a = np.cumsum(load), 0
    while a < len(load):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, "right")))
        yield a, z
        a = z


def best_of(chunks: Iterable[tuple[np.ndarray, list[tuple]]], qids: pa.Array, n: int) -> pa.RecordBatch:
    """The best ``n`` documents per query of chunks of ids and, for each field, document, first place, number of places and gain
    of each term, with the queries and weights that the places name."""
    width = len(qids)

    def best(q: np.ndarray, fid: np.ndarray, score: np.ndarray) -> np.ndarray:
        order = np.lexsort((fid, -score, q))
        first = np.r_[True, q[order][1:] != q[order][:-1]][: len(order)]
        starts = np.flatnonzero(first)
        return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < n]

    def scores(fields: list[tuple], a: int, z: int) -> np.ndarray:
        out = np.zeros((z - a) * width)
        for doc, first, size, part, who, weight in fields:
            here = slice(*np.searchsorted(doc, (a, z)))
            size = size[here]
            # each entry meets the queries of its term
            entry = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + first[here][entry]
            out += np.bincount((doc[here] - a)[entry] * width + who[at], part[here][entry] * weight[at], len(out))
        return out.reshape(z - a, width)

    q, fid, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(width)
    for ids, fields in chunks:
        load = np.full(len(ids), float(width))
        for doc, _, size, *_ in fields:
            load += np.bincount(doc, size, len(ids))
        for a, z in _steps(load):
            raw = scores(fields, a, z)
            s = np.round(raw, 6)
            d, w = np.nonzero((raw > 0) & (s >= least))
            q, fid, score = np.concatenate([q, w]), np.concatenate([fid, ids[a + d]]), np.concatenate([score, s[d, w]])
            if len(q) > 4 * n * width:
                keep = best(q, fid, score)
                q, fid, score = q[keep], fid[keep], score[keep]
                full = np.bincount(q, minlength=width) >= n
                least[full] = score[np.cumsum(np.bincount(q, minlength=width))[full] - 1]
    keep = best(q, fid, score)
    return pa.RecordBatch.from_arrays([pc.take(qids, pa.array(q[keep])), pa.array(fid[keep]), pa.array(score[keep])], ["qid", "fid", "score"])


def _search_block(asked: DataFrame, index: Index, n: int, boosts: dict[str, float], k1: float, b: float) -> DataFrame:
    entries = asked.toArrow()
    known = index.frequencies.where(F.col("field").isin(*boosts)).join(small(asked.select("term").distinct()), "term", "left_semi").toArrow()
    qids = pc.unique(entries["qid"].combine_chunks())
    query, term = pc.index_in(entries["qid"].combine_chunks(), qids).to_numpy(zero_copy_only=False), entries["term"].combine_chunks()
    qtf, sides = entries["qtf"].to_numpy(), {}
    for field, boost in boosts.items():
        here = known.filter(pc.equal(known["field"], field))
        words, df = here["term"].combine_chunks(), here["df"].to_numpy()
        at = pc.fill_null(pc.index_in(term, words), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(at >= 0)
        held = held[np.argsort(at[held], kind="stable")]
        docs, mean = index.totals[field]
        idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
        sides[field] = (words, np.searchsorted(at[held], np.arange(len(words) + 1)), query[held].astype(np.int64), qtf[held] * idf[at[held]] * boost, mean)
    sent = asked.sparkSession.sparkContext.broadcast(sides)

    def gains(batch: pa.RecordBatch) -> list[tuple]:
        """For each field: the places in its lists that a document's terms lead to, by document, and what a query gains there, without its weight."""
        out = []
        for i, (words, starts, who, weight, mean) in enumerate(sent.value.values()):
            dl, terms, tfs = batch.column(1 + 3 * i).to_numpy(), batch.column(2 + 3 * i), batch.column(3 + 3 * i)
            t = pc.fill_null(pc.index_in(terms.flatten(), words), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[t >= 0]
            tf, t = tfs.flatten().to_numpy()[t >= 0], t[t >= 0]
            part = tf / (tf + k1 * (1 - b + b * dl[doc] / mean))
            out.append((doc, starts[t], starts[t + 1] - starts[t], part, who, weight))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield best_of(((batch.column(0).to_numpy(), gains(batch)) for batch in batches), qids, n)

    columns = [c for f in boosts for c in (f"dl_{f}", f"terms_{f}", f"tfs_{f}")]
    return bounded(index.rows.select("id", *columns)).mapInArrow(run, f"qid {dict(asked.dtypes)['qid']}, fid long, score double")


def bm25_topk(queries: DataFrame, docs: DataFrame, n: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, terms) against (id, terms), by an index that is built for this search; see ``search``."""
    return search(queries, build_index(docs), n, None, k1, b)


def shingles(terms: Column, width: int) -> Column:
    """Runs of ``width`` terms joined by a space; none if there are fewer."""
    n = F.size(terms) - (width - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, width), " "))
    return F.when(n >= 1, runs).otherwise(F.array().cast("array<string>"))


def _run_hashes(hashes: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and 64-bit hash of all runs of ``width`` terms: the sum of the terms' hashes, each times an odd factor for its place."""
    flat = hashes.flatten().to_numpy().view(np.uint64)
    n = pc.fill_null(hashes.value_lengths(), 0).to_numpy(zero_copy_only=False)
    runs = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), runs)
    place = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = np.repeat(np.cumsum(n) - n, runs) + place
    out = np.zeros(len(row), np.uint64)
    for k in range(width):
        out += flat[start + k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
    return row, place, out.view(np.int64)


def _spelled(terms: pa.ListArray, row: np.ndarray, place: np.ndarray, width: int) -> pa.Array:
    """Runs as text, their terms joined by a space."""
    flat, n = terms.flatten(), pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False)
    start = (np.cumsum(n) - n)[row] + place
    picked = flat.take(pa.array((start[:, None] + np.arange(width)).ravel()))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(row) + 1, width, dtype=np.int32)), picked), " ")


def shared_run_truth(queries: DataFrame, docs: DataFrame, width: int = 8) -> DataFrame:
    """(qid, true_id): the smallest document that shares a run of ``width`` terms with the query.

    Up to four million hashes of the queries' runs are sent to the tasks, which look all runs of their documents up; more are joined
    by shuffle.  Only runs that met are spelled out, and they are compared as text.
    """
    hashed = lambda df, key: bounded(df.select(key, "terms", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes")))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, found = _run_hashes(batch.column(2), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _spelled(batch.column(1), row, place, width), pa.array(found)], ["qid", "run", "hash"])

    asked = materialize(hashed(queries, "qid").mapInArrow(asking, f"qid {dict(queries.dtypes)['qid']}, run string, hash long").distinct(), "asked-runs")
    runs, kind = asked.select("hash").distinct(), dict(docs.dtypes)["id"]
    if runs.count() <= SENT_RUNS:
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(runs.toArrow()["hash"].to_numpy()))

        def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, place, found = _run_hashes(batch.column(2), width)
                wanted = sent.value
                hit = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found if len(wanted) else np.zeros(len(found), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[hit])), _spelled(batch.column(1), row[hit], place[hit], width)], ["id", "run"])

        met = hashed(docs, "id").mapInArrow(meeting, f"id {kind}, run string")
    else:
        def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, place, found = _run_hashes(batch.column(2), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place), pa.array(found)], ["id", "at", "hash"])

        places = hashed(docs, "id").mapInArrow(all_of, f"id {kind}, at long, hash long").join(runs, "hash", "left_semi").groupBy("id").agg(F.collect_set("at").alias("at"))
        each = docs.join(places, "id").select("id", "terms", F.explode("at").alias("at"))
        met = each.select("id", F.array_join(F.slice("terms", F.col("at").cast("int") + 1, width), " ").alias("run"))
    least = materialize(met.groupBy("run").agg(F.min("id").alias("id")), "met-runs")
    return asked.join(least, "run").groupBy("qid").agg(F.min("id").alias("true_id"))
