"""SimHash near copies found with Golay-code fuzzy hashing.

Fingerprints link at three or fewer differing bits.  Their 64 bits are split into three segments,
which are read as 23-bit words of the perfect Golay code.  Three errors over three segments leave at
least two segments with at most one error each.  For such a segment of x and y the codeword
nearest to y lies within distance 4 of x, and the other way round.  So for each two segments
(A, B), x has the keys (any codeword within 4 of A, nearest to B) and y the keys (nearest to A, any
within 4 of B); one of them is equal.  A word has at most six codewords within distance 4.
Candidates that meet on a key are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.llm.exact_copies import without
from linkwell.operators.scale import skewed_join
from linkwell.storage import discard, materialize

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code of length 23 (a fixed value).
GENERATOR = 0b110001110101


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole UTF-8 text, as a signed integer; 0 if it has no words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return int(np.uint64(hash64(joined, SEED)).astype(np.int64))
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        m = min(n, k + (1 << 16))
        hashes = np.array([hash64(joined[a : b - 1], SEED) for a, b in zip(starts[k:m], starts[k + width : m + width], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, fp) for every row, from its whole text; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"), F.sha2(text, 256).alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "sha", "fp"])

    return bounded(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, sha string, fp long")


class Golay:
    """Codewords near 23-bit words.  ``errors[s]`` has the error patterns of weight at most 4 with syndrome s."""

    def __init__(self) -> None:
        single = [self._remainder(1 << i) for i in range(23)]
        self._low = self._syndromes(single[:12])
        self._high = self._syndromes(single[12:])
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        bits = [0]
        for weight in range(5):
            for e in bits:
                found[self._low[e & 0xFFF] ^ self._high[e >> 12]].append(e)
            bits = [e | 1 << i for e in bits for i in range(e.bit_length(), 23)] if weight < 4 else []
        # in order of weight: the first is the nearest codeword's
        self.errors = np.array([(x + [-1] * 6)[:6] for x in found], np.int64)
        assert max(map(len, found)) == 6

    @staticmethod
    def _remainder(x: int) -> int:
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        return x

    @staticmethod
    def _syndromes(single: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for s in single:
            out = np.concatenate([out, out ^ s])
        return out

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word six codeword indices (its upper 12 bits), nearest first, and which of the six exist."""
        e = self.errors[self._low[words & 0xFFF] ^ self._high[words >> 12]]
        return (words[:, None] ^ np.maximum(e, 0)) >> 11, e >= 0


def _keys(fps: np.ndarray, golay: Golay, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fp, key) rows of one side: key holds the two segments' numbers and their codeword indices."""
    raw = fps.view(np.uint64)
    near = [golay.near(((raw >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in SEGMENTS]
    out_fp, out_key = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (many, there), (nearest, _) = (near[a], near[b]) if left else (near[b], near[a])
        one = nearest[:, :1]
        key = (many << 12 | one if left else one << 12 | many) | pair << 24
        row, col = np.nonzero(there)
        out_fp.append(fps[row])
        out_key.append(key[row, col])
    return np.concatenate(out_fp), np.concatenate(out_key)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints of at most three differing bits."""

    def side(left: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            golay = Golay()
            for batch in batches:
                fp, key = _keys(batch.column(0).to_numpy(zero_copy_only=False), golay, left)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(key.astype(np.int32), pa.int32())], ["a" if left else "b", "key"])

        return bounded(fps.select("fp")).mapInArrow(run, f"{'a' if left else 'b'} long, key int")

    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    x, y = side(True), side(False)
    return x.join(y, (x["key"] == y["key"]) & close).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that is reachable.

    Large-star and small-star rounds: each hangs neighbours below the smallest node they can see,
    until no link changes.  Links are written to the shared folder between rounds; only their
    number and a checksum come to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b"), F.col("a")))
        else:  # from the larger node to smaller ones
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # a hub's links are not gathered: its least neighbour is broadcast to them
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).select("u", F.least("u", "m").alias("m"), "links")
        least = materialize(least, "links-least")
        hung = skewed_join(both, least, "u", "links")
        if large:
            hung = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = materialize(hung.where("a <> b").distinct(), "links")
        discard(least, e)
        return out

    def seen(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    now, before = materialize(edges.select("a", "b"), "links"), None
    while before != (mark := seen(now)):
        before, now = mark, star(star(now, True), False)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, fp, component_id) for every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprint-nodes")
    root = components(links(nodes))
    named = materialize(nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    by_print = skewed_join(named, ids, "root", "prints").select("fp", "rows", "component_id")
    return skewed_join(prints, materialize(by_print, "fingerprint-components"), "fp", "rows").select("doc_id", "sha", "fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts without words, null texts among them, have fingerprint zero and link like any other; texts of any length are
    read whole, their shingles hashed in blocks.  Null
    ids take part in links; a component of null ids only has a null component_id.  Rows that repeat
    an id keep their own fingerprints.  An empty table gives no rows; other columns are ignored.
    """
    return _members(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without near-copies, with all their columns: of each component the row of the smallest id.

    If rows repeat that id, the one whose text has the smallest digest stays; rows that repeat id and text stay
    together.  Components of null ids only keep all their rows.
    """
    rows = materialize(_members(docs, id_col, text_col).select("doc_id", "sha", "component_id"), "near-copies")
    head = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("sha").alias("head"))
    kept = rows.join(head, "component_id", "left")
    drop = kept.where((F.col("component_id").isNotNull()) & ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("head"))))
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return without(docs, docs[id_col], sha, drop.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).distinct())
