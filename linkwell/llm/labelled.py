"""A bounded sample of labelled texts that stays on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.storage import discard, materialize


def sample_rows(docs: DataFrame, labels: DataFrame, allowed: Column, most: int, best, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, sha, y, text): at most ``most`` labelled rows for which ``allowed`` (of doc_id) holds, whole texts, in the shared folder.

    Taken are those with the smallest hash of their id, so that reruns agree.  Null ids and labels other than 0 and 1
    are left out; of several labels of one id ``best`` (F.min or F.max) counts; rows that repeat id and text count once.
    The limit holds for the joined rows, so ids that repeat with other texts cannot pass it.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & allowed)
    chosen = chosen.groupBy("doc_id").agg(best("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = materialize(texts.join(F.broadcast(chosen), "doc_id").withColumn("sha", F.sha2("text", 256)), "labelled-found")
    keys = found.select("doc_id", "sha").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "sha").limit(most)
    out = materialize(found.join(F.broadcast(keys), ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]).select("doc_id", "sha", "y", "text"), "labelled")
    discard(found)
    return out
