"""How far the sources of a language diverge in their words, in exact integers.

Counts are folded per task, then by (lang, source, term).  Every language keeps the terms of enough
of its documents and cuts them into vocabulary chunks; a group's counts of one chunk make a packed
vector.  Groups fall into blocks, and a packed vector is sent to each pair of blocks that its own
block belongs to.  Such a task streams over the chunks in order, holds one chunk of two blocks at a
time and adds up the submatrix of all its pairs.  Long vocabularies are cut into segments whose
submatrices are summed, so a few sources with very many terms still spread over many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.operators.joins import small
from linkwell.storage import materialize

SCALE = 1_000_000_000
#: Mean terms of a chunk, mean groups of a block, chunks of a segment, and counts that a counting task holds at once.
CHUNK, BLOCK, SEGMENT, HELD = 4096, 16, 64, 200_000
#: A byte of a term stays (A-Z in lower case), all others become a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; the empty term marks that a group occurs."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def flush(held: dict[tuple[str, str], dict[bytes, list[int]]]) -> pa.RecordBatch:
        rows = [(lang, source, term.decode("utf-8", "replace"), n, k) for (lang, source), terms in held.items() for term, (n, k) in terms.items()]
        held.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        entries = 0
        for batch in batches:
            for lang, source, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = held.setdefault((lang, source), {b"": [0, 0]})
                before = len(terms)
                for term, n in Counter(body.translate(TERM_BYTES).split()).items():
                    if entry := terms.get(term):
                        entry[0] += n
                        entry[1] += 1
                    else:
                        terms[term] = [n, 1]
                entries += len(terms) - before
                if entries >= HELD:
                    yield flush(held)
                    entries = 0
        if held:
            yield flush(held)

    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    part = bounded(rows).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> str:
    """1 + floor(10^9 (n + 2) / total); the product may pass 64 bits."""
    return f"1 + (CAST({n} + 2 AS DECIMAL(28, 0)) * {SCALE}) DIV {total}"


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    if len(counts) and counts.max() > 9 * 10**9:
        return np.array([1 + SCALE * (n + 2) // total for n in counts.tolist()], np.int64)
    return 1 + SCALE * (counts + 2) // total


class _Tile:
    """The pair submatrix of one task, summed over vocabulary chunks."""

    def __init__(self, key: tuple) -> None:
        self.key, self.sums, self.chunk = key, None, None
        self.rows: list[tuple[str, int, np.ndarray]] = []

    def add(self, chunk: int, source: str, block: int, dense: np.ndarray) -> None:
        if chunk != self.chunk:
            self.fold()
            self.chunk = chunk
        self.rows.append((source, block, dense))

    def fold(self) -> None:
        if not self.rows:
            return
        _, first, second, _ = self.key
        self.left = [s for s, b, _ in self.rows if b == first]
        self.right = [s for s, b, _ in self.rows if b == second]
        if self.sums is None:
            self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        others = np.array([p for _, b, p in self.rows if b == second]).reshape(len(self.right), -1)
        for i, p in enumerate(p for _, b, p in self.rows if b == first):
            gap = others - p
            self.sums[i] += (gap * gap // (others + p)).sum(1)
        self.rows = []

    def pairs(self) -> pa.RecordBatch:
        self.fold()
        found = [
            (self.key[0], a, b, int(v)) for i, a in enumerate(self.left) for b, v in zip(self.right, self.sums[i], strict=True)
            if self.key[1] != self.key[2] or a < b]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Tile | None = None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["lang"], row["first"], row["second"], row["segment"])
            if now is None or now.key != key:
                if now:
                    yield now.pairs()
                now = _Tile(key)
            dense = np.zeros(0, np.int64)
            if row["terms"]:
                dense = np.full(row["terms"], _shares(np.zeros(1, np.int64), row["total"])[0])
                dense[np.array(row["places"] or [], np.int64)] = _shares(np.array(row["counts"] or [], np.int64), row["total"])
            now.add(row["chunk"], row["source"], row["block"], dense)
    if now:
        yield now.pairs()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the ``top`` terms of the group.

    Null texts, languages and sources count as empty strings.  A term is a run of ASCII letters and characters beyond
    ASCII, with A-Z in lower case; texts of any length are read whole.  A language keeps the terms of at least
    ``least_docs`` of its rows; rows that repeat, ids included, count one by one.  A group without terms takes part with
    counts of zero; a language without kept terms gives pairs of value 0; a lone source gives no pairs.  Equal values rank
    by item in UTF-8 order.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs)
    groups = counts.where("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang")), "lang", "left")
    langs = small(materialize(
        langs.select(
            "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"), F.ceil(F.col("sources") / BLOCK).alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / CHUNK)).alias("chunks")),
        "divergence-langs"))
    chunked = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    placed = chunked.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    terms = materialize(placed.select("lang", "term", "n_lang", "chunk", "place"), "divergence-terms")
    held = materialize(counts.where("term <> ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "divergence-held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", "blocks", "chunks", (F.coalesce("total", F.lit(0)) + 2 * F.col("kept")).alias("total"), (F.col("total_lang") + 2 * F.col("kept")).alias("total_lang"))
    totals = materialize(totals, "divergence-totals")
    return _pair_part(terms, held, totals).unionByName(_term_part(held, totals, top))


def _pair_part(terms: DataFrame, held: DataFrame, totals: DataFrame) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("place", "n")))  # one chunk's terms at most
    packed = held.groupBy("lang", "source", "chunk").agg(entries.alias("e")).select("lang", "source", "chunk", F.col("e.place").alias("places"), F.col("e.n").alias("counts"))
    sizes = terms.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("terms"))
    vectors = (
        totals.select("lang", "source", "total", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
        .join(sizes, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left"))
    tasks = vectors.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.floor(F.col("chunk") / SEGMENT).alias("segment"), "chunk", "source", "block",
        "total", F.coalesce("terms", F.lit(0)).alias("terms"), "places", "counts")
    key = ["lang", "first", "second", "segment"]
    tiles = bounded(tasks.repartition(*key).sortWithinPartitions(*key, "chunk", "source"), rows=64).mapInArrow(_tiles, "lang string, a string, b string, value long")
    pairs = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    return _ranked(both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value"))


def _term_part(held: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    both = held.join(totals.select("lang", "source", "total", "total_lang"), ["lang", "source"])
    p, q = F.expr(_share("n", "total")), F.expr(_share("n_lang", "total_lang"))
    over = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    ranked = _ranked(over.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value")))
    return ranked.where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
