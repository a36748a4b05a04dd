"""MinHash near copies found with a multi-index Hamming join of b-bit signatures.

A signature holds 64 minima of 16 bits each; its distance counts the minima that differ.  A pair of
Jaccard similarity 0.8 differs in 12.8 of them on average and in more than 27 with a probability
near 1e-5, which falls fast above 0.8.  Signatures are cut into 14 chunks: with 27 errors at most, one
chunk has at most one.  A chunk of r minima is indexed r times, each time without one of them, so
every pair within the distance meets under a key; nothing is capped.

Only sets that differ take part: rows of equal sets are one node.  Keys that one node holds alone go.
Large buckets are cut into tiles of two blocks.  A tile compares signatures and returns only as many
candidate pairs as it takes to connect what is near.  Their components, the pools, hold every
pair within the distance.

Links are confirmed on full sets.  A pool's most crowded node leads it: other sets are written as a
bit mask over the leader's shingles and the rest.  Nodes that link to the leader need no
comparison among themselves; all others are compared with every node of the pool, block by block:
common mask bits and the lesser rest bound the intersection, and where that could reach the
similarity the rests are intersected too, so the decision is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.llm.simhash import components
from linkwell.operators.scale import skewed_join
from linkwell.storage import discard, materialize

WIDTH, PERCENT = 4, 80
MINIMA, CHUNKS, MOST_ERRORS = 64, 14, 27
assert 2 * CHUNKS > MOST_ERRORS
BOUNDS = tuple(MINIMA * k // CHUNKS for k in range(CHUNKS + 1))
#: Nodes, and bytes of sets, of one block of a tile.
BLOCK_NODES, BLOCK_BYTES = 1024, 8 << 20
_draw = np.random.default_rng(12)
FACTORS = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles; with fewer words the sequence is one shingle."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash64(joined)] if words else [], np.uint64)
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    return np.unique(np.array([hash64(joined[a : b - 1]) for a, b in zip(starts, starts[width:], strict=False)], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of 64 minima of a set that is not empty."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        np.minimum(least, (FACTORS[:, None] * hashes[k : k + 4096] + TERMS[:, None]).min(1), out=least)
    return least.astype(np.uint16)


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, sha, n, digest, sig) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py(), width)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sig.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "sha", "n", "digest", "sig"])

    return bounded(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, sha binary, n long, digest binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


def keys(signatures: np.ndarray) -> np.ndarray:
    """64 keys of each signature: every chunk without each of its minima in turn, mixed with the position left out."""
    out = np.empty((len(signatures), MINIMA), np.uint64)
    wide = signatures.astype(np.uint64)
    for a, b in zip(BOUNDS, BOUNDS[1:], strict=False):
        for left_out in range(a, b):
            key = np.full(len(wide), left_out + 1, np.uint64) * MIX
            for k in range(a, b):
                if k != left_out:
                    key = (key ^ wide[:, k]) * MIX
                    key ^= key >> np.uint64(29)
            out[:, left_out] = key
    return out


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node): 64 rows for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(_matrix(batch.column(1))) if len(batch) else np.empty((0, MINIMA), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), MINIMA))], ["key", "node"])

    return bounded(nodes.select("node", "sig")).mapInArrow(run, "key long, node long")


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first ``width`` columns (no nulls); one group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in range(width)):
            new = _changes(batch, width)
            if not len(new):
                held.append(batch)
                continue
            held.append(batch.slice(0, new[0]))
            batch = batch.slice(new[0])
        if held:
            yield pa.Table.from_batches(held)
            held = []
        new = _changes(batch, width)
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _changes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows at which a new group begins, but the first."""
    changed = np.zeros(max(0, len(batch) - 1), bool)
    for k in range(width):
        c = batch.column(k).to_numpy(zero_copy_only=False)
        changed |= c[1:] != c[:-1]
    return np.nonzero(changed)[0] + 1


def _spans(table: pa.Table, width: int) -> list[tuple[int, int]]:
    if not len(table):
        return []
    starts = [0, *_changes(table.combine_chunks().to_batches()[0], width).tolist(), len(table)]
    return list(zip(starts, starts[1:], strict=False))


def _near(nodes: np.ndarray, sigs: np.ndarray, block: np.ndarray, first: int, second: int) -> list[tuple[int, int]]:
    """As few pairs within the distance as connect all that are, between two blocks or inside one."""
    left = np.nonzero(block == first)[0]
    right = np.nonzero(block == second)[0]
    label, out = np.arange(len(nodes)), []
    for i in left:
        others = right[right > i] if first == second else right
        others = others[label[others] != label[i]]
        close = others[(sigs[others] != sigs[i]).sum(1) <= MOST_ERRORS]
        for one in np.unique(label[close], return_index=True)[1]:
            j = close[one]
            out.append((int(nodes[i]), int(nodes[j])))
        label[np.isin(label, label[close])] = label[i]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches, 3):
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        first, second = table["first"].to_numpy(), table["second"].to_numpy()
        sigs = _matrix(table["sig"].combine_chunks())
        spans = np.array(_spans(table, 3))
        two = spans[spans[:, 1] - spans[:, 0] == 2][:, 0]  # most buckets
        two = two[((sigs[two] != sigs[two + 1]).sum(1) <= MOST_ERRORS) & (block[two] == first[two]) & (block[two + 1] == second[two])]
        out = list(zip(node[two].tolist(), node[two + 1].tolist(), strict=True))
        for a, b in spans[spans[:, 1] - spans[:, 0] > 2]:
            out += _near(node[a:b], sigs[a:b], block[a:b], first[a], second[a])
        low = np.array(out, np.int64).reshape(-1, 2)
        low.sort(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(low[:, 0]), pa.array(low[:, 1])], ["a", "b"])


def _pools(nodes: DataFrame, crowds: DataFrame) -> DataFrame:
    """(node, root) of every node that another one is near to; ``crowds`` has (key, node, n) of keys with n > 1 nodes."""
    blocks = F.ceil(F.col("n") / BLOCK_NODES)
    rows = crowds.select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node").join(nodes.select("node", "sig"), "node")
    rows = rows.select("key", "first", "second", "block", "node", "sig")
    tiles = rows.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "block")
    near = bounded(tiles, rows=8000).mapInArrow(_candidates, "a long, b long").distinct()
    return components(materialize(near, "minhash-near"))


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame, most: int = 200_000) -> DataFrame:
    """(pool, node, shingles) of the rows that ``wanted`` (doc, sha, pool, node) names, from their whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    if wanted.limit(most + 1).count() <= most:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc"]) & (F.unhex(F.sha2("text", 256)) == wanted["sha"])).select("pool", "node", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(2)], pa.binary())], ["pool", "node", "shingles"])

    return bounded(found).mapInArrow(run, "pool long, node long, shingles binary")


def _linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _relative(sets: DataFrame, percent: int) -> DataFrame:
    """Sets beside their pool's leader: (pool, node, leader, n, mask, rest, core); core sets link to the leader or are it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mask, rest, core = [], [], [], []
            for own, lead in zip(batch.column(3), batch.column(4), strict=True):
                own, lead = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(lead.as_py(), np.uint64)
                there = np.isin(lead, own, assume_unique=True)
                n.append(len(own))
                mask.append(np.packbits(there, bitorder="little").tobytes())
                rest.append(np.setdiff1d(own, lead, assume_unique=True).tobytes())
                core.append(_linked(int(there.sum()), len(own), len(lead), percent))
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(mask, pa.binary()), pa.array(rest, pa.binary()), pa.array(core, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["pool", "node", "leader", "n", "mask", "rest", "core"])

    rows = bounded(sets.select("pool", "node", "leader", "shingles", "lead"))
    return rows.mapInArrow(run, "pool long, node long, leader long, n long, mask binary, rest binary, core boolean")


def _confirm(percent: int):
    def words(masks: list[bytes]) -> np.ndarray:
        width = -(-max(map(len, masks)) // 8) * 8
        return np.frombuffer(b"".join(m.ljust(width, b"\0") for m in masks), np.uint64).reshape(len(masks), -1)

    def tile(t: pa.Table) -> list[tuple[int, int]]:
        node, block, n = (t[c].to_numpy() for c in ("node", "block", "n"))
        first, second = t["first"][0].as_py(), t["second"][0].as_py()
        masks, rest = words(t["mask"].to_pylist()), [np.frombuffer(r, np.uint64) for r in t["rest"].to_pylist()]
        lengths = np.array([len(r) for r in rest])
        core = t["core"].to_numpy(zero_copy_only=False).astype(bool)
        label = np.where(core, -1, np.arange(len(node)))
        left, right, out = np.nonzero(block == first)[0], np.nonzero(block == second)[0], []
        for i in left:
            others = right[right > i] if first == second else right
            others = others[label[others] != label[i]]
            most = np.minimum(n[others], n[i])
            others = others[_linked_all(most, n[others], n[i])]
            if not len(others):
                continue
            common = np.bitwise_count(masks[others] & masks[i]).sum(1, dtype=np.int64)
            bound = common + np.minimum(lengths[others], lengths[i])
            may = np.nonzero(_linked_all(bound, n[others], n[i]))[0]
            for k in may[np.argsort(-bound[may], kind="stable")]:
                j = others[k]
                if label[i] == label[j]:
                    continue
                both = int(common[k]) + len(np.intersect1d(rest[i], rest[j], assume_unique=True))
                if _linked(both, int(n[i]), int(n[j]), percent):
                    out.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
        return out

    def _linked_all(common: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
        return 100 * common >= percent * (n + m - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            out = [pair for a, b in _spans(table, 3) for pair in tile(table.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

    return run


def _links(sets: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b), as many as connect each component of them."""
    ranked = sets.select("pool", "node", F.length("shingles").alias("bytes")).join(weights, "node")
    leaders = ranked.groupBy("pool").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"), F.count(F.lit(1)).alias("members"))
    leads = leaders.join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("lead")), "leader").select("pool", "leader", "members", "lead")
    relative = materialize(_relative(skewed_join(sets, materialize(leads, "minhash-leaders"), "pool", "members"), percent), "minhash-relative")
    held = F.length("mask") + F.length("rest")

    def blocks(of: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(of) / BLOCK_NODES), F.ceil(F.sum(F.when(of, held).otherwise(0)) / BLOCK_BYTES))

    core = F.col("core")
    crowd = relative.groupBy("pool").agg(blocks(core).alias("cores"), blocks(~core).alias("outer"), F.count(F.lit(1)).alias("members")).where("outer > 0")
    rows = skewed_join(relative, materialize(crowd, "minhash-pools"), "pool", "members")
    block = F.when(core, F.col("outer") + F.pmod(F.xxhash64("node"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer")))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(core, F.col("outer")).otherwise(F.col("outer") + F.col("cores")) - 1)))
    rows = rows.select("pool", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "n", "mask", "rest", "core")
    tiles = rows.repartition("pool", "first", "second").sortWithinPartitions("pool", "first", "second", "block", "node")
    found = bounded(tiles).mapInArrow(_confirm(percent), "a long, b long")
    own = relative.where(core & (F.col("node") != F.col("leader"))).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return own.unionByName(found)


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for every input row: id, n_shingles, component_id (smallest id reachable), kept.

    Sets link whose Jaccard similarity is ``percent`` / 100 or more, which must be at least 80, since the signature's
    distance is set for that.  Texts without words, null texts among them, have no shingles and link with nothing, not even
    with each other; texts of any length are read whole.  Null ids take part in links; a component of
    null ids only has a null component_id and keeps its rows.  Rows that repeat an id keep their own sets.  An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {PERCENT} and 100, not {percent}")
    prints = materialize(_prints(docs, id_col, text_col, width), "minhash-prints")
    groups = prints.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "sha")).alias("first"), F.max("sig").alias("sig"))
    nodes = materialize(groups.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "rows", "first", "sig"), "minhash-nodes")
    keyed = _keyed(nodes)
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-shared")
    crowds = materialize(skewed_join(keyed, shared.withColumn("rows", F.col("n")), "key", "rows"), "minhash-crowds")
    pools = _pools(nodes, crowds).select("node", F.col("root").alias("pool"))
    pools = materialize(pools.unionByName(pools.select(F.col("pool").alias("node"), "pool")).distinct(), "minhash-pooled")
    wanted = materialize(nodes.join(pools, "node").select(F.col("first.doc_id").alias("doc"), F.col("first.sha").alias("sha"), "pool", "node"), "minhash-wanted")
    sets = materialize(_sets(docs, id_col, text_col, width, wanted), "minhash-sets")
    if sets.count() > wanted.count():  # rows that repeat both id and text
        sets = materialize(sets.dropDuplicates(["node"]), "minhash-sets")
    weights = crowds.groupBy("node").agg(F.sum("n").alias("weight"))
    root = components(_links(sets, weights, percent).distinct())
    named = materialize(nodes.join(root, "node", "left").select("digest", "least", "rows", F.coalesce("root", "node").alias("root")), "minhash-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    by_set = materialize(skewed_join(named, ids, "root", "sets").select("digest", "rows", "component_id"), "minhash-components")
    some = skewed_join(prints.where("n > 0"), by_set, "digest", "rows").select("doc_id", "n", "component_id")
    found = some.unionByName(prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    discard(shared, crowds, sets)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
