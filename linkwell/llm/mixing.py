"""Mixing sources to target weights with nested hash thresholds; nothing is sorted.

Every document has a 48-bit hash of its id and text.  A source whose target is r times its size takes every
document floor(r) times, and once more those whose hash lies below a threshold.  The threshold is
found digit by digit: tokens are summed by (source, hash digit), the budget picks the boundary
bucket, and only the documents of that bucket are summed by their next digit.  After the last
digit the boundary is one hash value: one document, or rows that repeat one.  Of these as many are taken as
bring the source nearest its target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.operators.scale import running, with_one
from linkwell.storage import discard, materialize

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS, DIGIT_BITS = 48, 12
#: Broadcast limit for the table of thresholds, which has one row for each source.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """The first 48 bits of md5 over the id's decimal text, a colon and the whole text; nulls hash as empty."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, weigh ``weights``, repeating.  Together they get
    ``share`` of all tokens; no target passes ``most`` times its source's size, and what is cut off
    goes to the others by weight.  Whether a source is cut follows from its size per weight: in
    that order, the cut ones are a prefix.  Both orders run by range partitions, for there may be many sources.
    """
    cycle, last = F.array(*[F.lit(w).cast("long") for w in weights]), F.col("source").asc_nulls_last()
    t = running(sizes.select("source", "source_size"), [last], {"place": F.lit(1).cast("long")})
    t = t.select("source", "source_size", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("w"), (F.lit(most) * F.col("source_size")).cast("long").alias("cap"))
    t = running(t, [F.col("cap") / F.col("w"), last], {"cap0": F.col("cap"), "w0": F.col("w")})
    t = t.withColumns({"cap0": F.col("cap0") - F.col("cap"), "w0": F.col("w0") - F.col("w")})
    t = with_one(t, t.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w")))
    t = t.withColumn("cut", F.col("cap") * (F.col("all_w") - F.col("w0")) <= F.col("w") * (F.lit(share) * F.col("all_size") - F.col("cap0")))
    t = with_one(t, t.agg(*[F.sum(F.when(F.col("cut"), F.col(c)).otherwise(0)).alias(f"cut_{c}") for c in ("cap", "w")]))
    free = F.col("w").cast("double") * (F.lit(share) * F.col("all_size") - F.col("cut_cap")) / (F.col("all_w") - F.col("cut_w"))
    return t.select("source", "source_size", F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(free).alias("target"))


def thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """One row per source: source, source_size, target, times, below (hash limit of the extra copy), repeated, extra.

    Rows of hash ``below`` number ``repeated``, and ``extra`` of them are taken.
    """
    lean = materialize(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")), "mix-sizes")
    goal = targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), **rule)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.withColumn("times", ratio.cast("long")).select("source", "source_size", "target", "times", (F.col("target") - F.col("times") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    state = materialize(state, "mix-goal")
    small = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        last = shift == 0
        digit = F.shiftright("hash", shift)
        d, s = lean.select(F.col("source").alias("src"), "size", digit.alias("digit"), F.shiftright("hash", shift + DIGIT_BITS).alias("above")), state
        inside = d.join(hint(s.select(F.col("source").alias("s"), "prefix")), F.col("src").eqNullSafe(F.col("s")) & (F.col("above") == F.col("prefix")))
        sums = inside.groupBy("src", "digit").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        run = Window.partitionBy("src").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run)).join(hint(s.select(F.col("source").alias("s"), "left")), F.col("src").eqNullSafe(F.col("s")))
        # the boundary: the first bucket whose running sum passes what is left
        edge = sums.where(F.col("upto") > F.col("left")).groupBy("src").agg(F.min(F.struct("digit", "words", "upto", "rows")).alias("e"))
        found = s.join(edge, F.col("source").eqNullSafe(F.col("src")), "left")
        left = F.col("left") - (F.col("e.upto") - F.col("e.words"))
        # -1: all of the bucket above fits; the limit is then its end
        prefix = F.coalesce(F.col("e.digit"), (F.col("prefix") + 1) * (1 << DIGIT_BITS) - (0 if last else 1))
        state = found.select("source", "source_size", "target", "times", F.coalesce(left, F.lit(float("inf"))).alias("left"), prefix.alias("prefix"), "e")
        if not last:
            state = state.drop("e")
        old, state = s, materialize(state, "mix-level")
        discard(old)
    # the rows of the boundary's hash are equal in size; one more is taken if that is nearer
    each, rows = F.col("e.words") / F.col("e.rows"), F.coalesce(F.col("e.rows"), F.lit(0))
    fit = F.floor(F.col("left") / each)
    extra = fit + ((fit + 1) * each - F.col("left") < F.col("left") - fit * each).cast("long")
    discard(lean)
    return state.select("source", "source_size", "target", "times", F.col("prefix").alias("below"), rows.alias("repeated"), F.coalesce(F.least(extra, rows), F.lit(0)).cast("long").alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """The input's rows with _size, _source_size, _target and _copies (how often the mix takes the row).

    Null and empty texts have size 0; texts of any length are read whole.  A null source is a source of its own, ordered
    last; null ids are ids like others.  Rows that repeat an id with another text are taken one by one, and so are rows
    that repeat both, which of them being left open.  No row is taken more than ``most`` times.  An empty table gives no
    rows.  Input columns keep their names and values; one that has the name of a new column is replaced by it.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies")
    limits = materialize(thresholds(docs, id_col, text_col, source_col, **rule), "mix-limits")
    repeats = not limits.where("repeated > 1").isEmpty()
    small = limits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    mine = {c: f"_{c}_{uuid.uuid4().hex[:8]}" for c in [*limits.columns, "hash", "place"]}
    limits = limits.withColumnsRenamed(mine)
    at = lambda c: F.col(mine[c])
    joined = docs.join(F.broadcast(limits) if small else limits, docs[source_col].eqNullSafe(at("source"))).withColumn(mine["hash"], row_hash(F.col(id_col), F.col(text_col)))
    most = F.lit(rule.get("most", 2)).cast("long")

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(*docs.columns, word_count(F.col(text_col)).alias("_size"), at("source_size").alias("_source_size"), at("target").alias("_target"), F.least(at("times") + extra.cast("long"), most).alias("_copies"))

    below = at("hash") < at("below") + (at("extra") > 0).cast("long")
    if not repeats:
        return out(joined, below)
    # sources whose boundary is a repeated row: only the rows of that hash are numbered
    at_edge = (at("hash") == at("below")) & (at("repeated") > 1)
    numbered = joined.where(at_edge).withColumn(mine["place"], F.row_number().over(Window.partitionBy(at("source")).orderBy(at("hash"))))
    return out(joined.where(~at_edge), below).unionByName(out(numbered, at("place") <= at("extra")))
