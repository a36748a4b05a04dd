"""Groups of exact copies, found so that no hot text can overload a task.

1. Local: Spark's partial aggregation folds equal texts inside each input partition.
2. Salted: the survivors are grouped by (digest, salt, text); a text with a third of all rows
   reaches ``salts`` tasks instead of one.
3. Global: at most ``salts`` winners of each text are combined.

The whole text is a grouping key at every stage, so equal digests of different texts never merge.
Documents then find their group by (digest, salt), which carries no text; only if a digest turns
out to hold several texts, the rows of such digests are matched by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.storage import materialize


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row for every input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the largest id stays.
    A null id loses against any other; if all ids of a group are null, keep_id is null and its rows
    count as kept.  Rows that repeat both id and text are the same document: each of them counts in
    group_size and reports the same ``kept``.  Texts of any length are read and compared whole, in the JVM.  An empty
    table gives no rows; other columns of the input are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", "text", F.encode(digest(F.col("text")), "UTF-8").alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "text").agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    groups = materialize(whole.select("digest", "keep_id", "group_size", "salts"), "exact-groups")
    ambiguous = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    by_salt = groups.select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    lean = rows.select("doc_id", "digest", "salt", F.sha2("text", 256).alias("text_sha256"))
    if ambiguous.isEmpty():
        found = lean.join(by_salt, ["digest", "salt"])
    else:
        clear = lean.join(by_salt.join(ambiguous, "digest", "left_anti"), ["digest", "salt"])
        full = whole.join(ambiguous, "digest", "left_semi").select("digest", "text", F.explode("salts").alias("salt"), "keep_id", "group_size")
        texts = rows.join(ambiguous, "digest", "left_semi").join(full, ["digest", "salt", "text"])
        found = clear.unionByName(texts.select("digest", "salt", "doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return found.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The input's rows whose text is kept, with all their columns.

    A row is judged by its id and text, so a repeated id with another text is judged alone.  Of rows that repeat both,
    null and empty texts being equal, the one whose other columns come first as JSON text stays (null members are left
    out of it), so reruns keep the same row.  Nulls, long texts and empty tables are treated as in ``exact_copies``.
    """
    verdict = materialize(exact_copies(docs, id_col, text_col, salts).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "exact-verdict")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    left = without(docs, docs[id_col], sha, verdict.where(~F.col("kept")).select("_id", "_sha").distinct())
    repeated = verdict.where("kept").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_sha")
    if repeated.isEmpty():
        return left
    once = without(left, left[id_col], sha, repeated)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])), F.col(text_col).isNull())
    rows = left.select(whole.alias("row"), left[id_col].alias("id"), sha.alias("digest"), order.alias("order"))  # the input's names may be any
    again = rows.join(repeated, rows["id"].eqNullSafe(repeated["_id"]) & (rows["digest"] == repeated["_sha"]))
    one = again.groupBy("_id", "_sha").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return once.unionByName(one)


def without(docs: DataFrame, key: Column, sha: Column, drop: DataFrame, most: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose (key, sha) stands in ``drop`` (_id, _sha).

    Up to ``most`` rows of ``drop`` are broadcast; beyond that the join shuffles.
    """
    if drop.limit(most + 1).count() <= most:
        drop = F.broadcast(drop)
    return docs.join(drop, key.eqNullSafe(drop["_id"]) & (sha == drop["_sha"]), "left_anti")
