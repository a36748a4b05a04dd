"""The feature table of candidate pairs: similarities, TF-IDF and embedding distances, retrieval score and place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwell.functions.similarity import pair_features
from linkwell.operators.joins import null_safe
from linkwell.operators.vectors import DISTANCES, sparse_dot, vector_set_distances

KEY = ["qid", "synid", "fid"]
#: Names of the embedding distances: of the means, then mean, median and deviation of the least distances.
EMBEDDING = ("fasttext0", "fasttext1", "fasttext2", "fasttext3")


#: Words, and bytes of words and vectors, up to which a vocabulary is sent to every task.
VOCABULARY_WORDS, VOCABULARY_BYTES = 1_000_000, 128 << 20


def _sent(vocabulary: DataFrame, columns: list[str]) -> pa.Table | None:
    """The vocabulary's distinct words in memory, or None if it is too large for every task."""
    words = vocabulary.where("word IS NOT NULL").dropDuplicates(["word"]).select("word", *columns)
    width = sum(F.size(c) * 8 if dict(vocabulary.dtypes)[c].startswith("array") else F.lit(8) for c in columns) if columns else F.lit(0)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + F.coalesce(width, F.lit(0))).alias("b")).first()
    return words.toArrow().combine_chunks() if size["n"] <= VOCABULARY_WORDS and (size["b"] or 0) <= VOCABULARY_BYTES else None


def _looked_up(texts: DataFrame, tokens: str, table: pa.Table, out: str, kind: str, made) -> DataFrame:
    """``texts`` with the column ``out``, which ``made`` (place of each token or -1, lengths of the lists) gives, by lookups inside the row."""
    sent = texts.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in texts.columns if c != out]
    types = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_tokens"))
            found = pc.fill_null(pc.index_in(lists.flatten(), sent.value["word"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
            column = made(found, pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), sent.value, lists)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], column], [*kept, out])

    rows = texts.select(*kept, F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("_tokens"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{out}` {kind}").select(*texts.columns, *([] if out in texts.columns else [out]))


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def _held(found: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat list of the tokens that were found, and how many each list has of them."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.flatnonzero(found >= 0), np.bincount(row[found >= 0], minlength=len(lengths))


def known_tokens(texts: DataFrame, key: list[str], vocabulary: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``texts`` with only the tokens that the vocabulary (word) holds, in order; none left gives an empty array.

    A vocabulary of bounded size is looked up inside the row; a larger one is joined.
    """
    if (table := _sent(vocabulary, [])) is not None:
        def made(found, lengths, table, lists):
            at, n = _held(found, lengths)
            return _lists(lists.flatten().take(pa.array(at)), n)

        return _looked_up(texts, tokens, table, tokens, "array<string>", made)
    each = texts.select(*key, F.posexplode(tokens).alias("_i", "word")).join(vocabulary.select("word").distinct(), "word", "left_semi")
    held = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]).alias("_held"))
    return null_safe(texts, held, key, "left").withColumn(tokens, F.coalesce("_held", F.array().cast("array<string>"))).drop("_held")


def token_vectors(texts: DataFrame, key: list[str], vectors: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(key, vectors): the vectors (word, vector) of each text's known tokens, in order.

    Give it every text once: the vectors of a query then serve all its pairs.  Vectors of bounded size are looked up inside
    the row; larger ones are joined.
    """
    vectors = vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    if (table := _sent(vectors, ["vector"])) is not None:
        def made(found, lengths, table, lists):
            at, n = _held(found, lengths)
            return _lists(table["vector"].combine_chunks().take(pa.array(found[at])), n)

        rows = texts.select(*key, F.col(tokens).alias("_words"))
        return _looked_up(rows, "_words", table, "vectors", "array<array<double>>", made).drop("_words")
    each = texts.select(*key, F.posexplode(tokens).alias("_i", "word")).join(vectors.withColumnRenamed("vector", "_v"), "word")
    held = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("vectors"))
    return null_safe(texts.select(*key), held, key, "left").withColumn("vectors", F.coalesce("vectors", F.array().cast("array<array<double>>")))


def vocabulary_ids(texts: DataFrame, key: list[str], vocabulary: DataFrame, tokens: str = "tokens", missing: int = -1) -> DataFrame:
    """``texts`` with the ids of their tokens in a vocabulary (word, id), in order, as ``ids``; ``missing`` for unknown ones.

    A vocabulary of bounded size is looked up inside the row; a larger one is joined.
    """
    words = vocabulary.select("word", F.col("id").cast("long").alias("id"))
    if (table := _sent(words, ["id"])) is not None:
        def made(found, lengths, table, lists):
            ids = np.r_[table["id"].to_numpy(), missing]
            return _lists(pa.array(ids[np.where(found >= 0, found, len(ids) - 1)].astype(np.int64)), lengths)

        return _looked_up(texts, tokens, table, "ids", "array<bigint>", made)
    each = texts.select(*key, F.posexplode(tokens).alias("_i", "word")).join(words.withColumnRenamed("id", "_id"), "word", "left")
    held = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_id", F.lit(missing)).alias("_id")))), lambda x: x["_id"]).alias("ids"))
    return null_safe(texts, held, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def one_of_each(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (qid, synid, fid); null keys are equal."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return pairs.withColumn("_place", place).where("_place = 1").drop("_place")


def pair_dataset(samples: DataFrame, distances: list[DataFrame], native: dict | None = None, arrow: bool = True, fill: float = -1.0) -> DataFrame:
    """Samples (qid, synid, fid, target, score, ix, q_terms, d_terms) to one row of features for each pair.

    Score and place are features too.  Each frame of ``distances`` holds the key and its columns, one row for a pair,
    and is joined null-safe; a pair that one of them lacks is left out.  Null features become ``fill``.
    """
    rows = pair_features(one_of_each(samples, ["ix"]), native=native, arrow=arrow).drop("q_terms", "d_terms")
    for d in distances:
        rows = null_safe(rows, d.dropDuplicates(KEY), KEY)
    filled = [c for c in rows.columns if c not in (*KEY, "target", "existing", "train", "vali")]
    return rows.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(fill)), F.lit(fill)).alias(c) if c in filled else F.col(c) for c in rows.columns])


def tfidf_distances(pairs: DataFrame, q_weights: DataFrame, d_weights: DataFrame, name: str = "tfidf0") -> DataFrame:
    """The key and the distance of pairs; weights by (qid, synid) and by fid, from ``vectors.tfidf``."""
    q = q_weights.select("qid", "synid", F.col("words").alias("_x"), F.col("weights").alias("_xw"))
    d = d_weights.select("fid", F.col("words").alias("_y"), F.col("weights").alias("_yw"))
    both = null_safe(pairs.select(*KEY), q, ["qid", "synid"], "left").join(d, "fid", "left")
    size = F.col("_x").isNotNull().cast("double") + F.col("_y").isNotNull().cast("double")
    return both.withColumn("_dot", sparse_dot("_x", "_xw", "_y", "_yw")).select(*KEY, (size / 2 - F.col("_dot")).alias(name))


def vector_distances(pairs: DataFrame, q_vectors: DataFrame, d_vectors: DataFrame) -> DataFrame:
    """The key and the four embedding distances of pairs; vectors by (qid, synid) and by fid, from ``token_vectors``."""
    both = null_safe(pairs.select(*KEY), q_vectors.withColumnRenamed("vectors", "_q"), ["qid", "synid"]).join(d_vectors.withColumnRenamed("vectors", "_d"), "fid")
    return both.withColumn("_e", vector_set_distances("_q", "_d")).select(*KEY, *[F.col(f"_e.{d}").alias(n) for d, n in zip(DISTANCES, EMBEDDING, strict=True)])


def with_predictions(samples: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Samples with the probability of their pair id; a pair without a prediction has none."""
    return samples.join(predictions.select(F.col(key).alias("_p"), "prob"), F.col(key) == F.col("_p"), "left").drop("_p")


def training_sentences(feed: DataFrame, master: DataFrame, held_out: DataFrame, tokens) -> DataFrame:
    """(words) for embeddings: names, descriptions, synonyms and mistypes of the master and of feed rows that are not held out.

    Both frames hold id, name, description and the arrays synonyms and mistypes of structs with a name; ``tokens`` is a
    function of a text column.  Null arrays count as empty, and texts without words are left out.
    """
    rows = feed.join(held_out.select(F.col("qid").alias("id")).distinct(), "id", "left_anti").unionByName(master)
    none = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.transform(c, lambda s: s["name"]), none)
    texts = rows.select(F.explode(F.concat(F.array("name", "description"), names("synonyms"), names("mistypes"))).alias("text")).where("text IS NOT NULL")
    return texts.select(tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
