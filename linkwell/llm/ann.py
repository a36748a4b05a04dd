"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

Build.  Vectors of equal 8-bit code share one node.  Nodes start from neighbours in the leaves of random projection
trees, and from a few random ones, which connect the graph.  Each round deals nodes and their messages out by node:
proposals, which improve its list, and nodes that list it.  The node compares its neighbours
(both directions) with each other, wherever one of a pair is new, and proposes the better pairs to both.
Messages carry vectors as 8-bit codes, so a round is one shuffle and one pass over sorted rows.  Only the
best proposals and a random share of back links are read, which bounds the inbox of a hub.  Rounds
go on until few list entries change; lists only ever improve, so they end.

Search.  A query starts at its own node's list and repeatedly expands the best nodes of its pool
that it has not expanded, again one join a round, until it has expanded its whole pool.  All vectors of
the pool's nodes are scored in double precision, but for nodes that the error of the codes rules out.

Similarities of codes come from whole-number products, so they are exact and the same wherever they are computed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.operators.scale import skewed_join
from linkwell.storage import discard, materialize


@dataclass(frozen=True)
class Settings:
    """``degree``: neighbours of a node.  ``sample``: new and old neighbours that a node tells of itself in a round.
    ``inbox``: most messages of a kind that a node reads in a round; ``offers``: most pairs that a
    node proposes to one of its neighbours.  ``settled``: share of list entries that change in the last round (from the third on).
    ``bucket``, ``trees``: size and number of the first neighbourhoods; ``rings``, ``ring``: number of random
    groups of a node and of neighbours on each side in them.  ``fitted``: most nodes that the trees are fitted on.
    ``pool``, ``beam``: of the search."""

    degree: int = 32
    sample: int = 10
    inbox: int = 64
    offers: int = 3
    settled: float = 0.1
    bucket: int = 128
    trees: int = 2
    rings: int = 2
    ring: int = 3
    fitted: int = 20_000
    pool: int = 320
    beam: int = 64
    seed: int = 5


#: Rows of an Arrow batch here, and bytes up to which a search's front is broadcast.
ROWS, FRONT_BYTES = 8_000, 16 << 20
#: Of the rounds' tables: codes hardly shrink, and this codec holds little memory outside the heap.
CODEC = "snappy"
#: Nodes (kind -1: ``src`` entries have changed, ``lists`` holds the packed list) and messages to ``dst`` about ``src``.
ROW = "dst long, kind int, src long, sim double, floor double, fresh boolean, code binary, lists binary"
_ROW = pa.schema([("dst", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), ("sim", pa.float64()), ("floor", pa.float64()), ("fresh", pa.bool_()), ("code", pa.binary()), ("lists", pa.binary())])
NODE, OFFER, BACK = -1, 0, 1
NONE = -2.0  # below any cosine


# packed lists

def entry(dims: int) -> np.dtype:
    """An entry of a node's list: a neighbour, its own worst similarity when last heard of, whether it is new, its code."""
    return np.dtype([("id", "<i8"), ("sim", "<f8"), ("floor", "<f8"), ("fresh", "?"), ("code", "i1", (dims,))])


def _column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _binary(codes: np.ndarray) -> pa.Array:
    n, d = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * d).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of codes."""
    if not len(column):
        return np.zeros((0, dims), np.int8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(len(column), dims)


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Vectors as 8-bit integers, each at its own scale, which a cosine does not see."""
    return np.rint(vectors / np.abs(vectors).max(1, keepdims=True) * 127).astype(np.int8)


def _whole(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in a type whose products of them are exact, and their lengths."""
    kind = np.float32 if codes.shape[-1] <= 1000 else np.float64
    return codes.astype(kind), np.sqrt(np.square(codes.astype(np.float64)).sum(-1))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two tables of codes, or of each pair of tables."""
    (x, n), (y, m) = _whole(a), _whole(b)
    return (x @ np.swapaxes(y, -1, -2)).astype(np.float64) / np.maximum(n[..., :, None] * m[..., None, :], 1e-300)


def paired(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a with rows b."""
    x, n = _whole(codes)
    return np.einsum("ij,ij->i", x[a], x[b]).astype(np.float64) / np.maximum(n[a] * n[b], 1e-300)


def _messages(kind, dst, src, sim, floor, fresh, codes) -> pa.RecordBatch:
    n = len(dst)
    return pa.RecordBatch.from_arrays(
        [pa.array(dst, pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(src, pa.int64()), pa.array(sim, pa.float64()), pa.array(floor, pa.float64()), pa.array(fresh, pa.bool_()), _binary(codes), pa.nulls(n, pa.binary())], schema=_ROW)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tame(v: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, at another scale."""
    top = np.abs(v).max(1, keepdims=True)
    return np.where((top > 1e100) | (top < 1e-100), v / top, v)


def _mix(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A hash of two columns of ids."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn * 0x165667B19E3779F9 % (1 << 64))
        for shift in (31, 29):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _place(groups: np.ndarray) -> np.ndarray:
    """Of each row its number inside its run of equal values."""
    n = len(groups)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part.  Of several vector lengths the most frequent one does (the longer on ties)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


# first neighbours

@dataclass(frozen=True)
class Tree:
    """A random projection tree: node i has the children 2i + 1 and 2i + 2."""

    directions: np.ndarray
    limits: np.ndarray
    depth: int

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        unit, at = _units(codes), np.zeros(len(codes), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", unit, self.directions[at]) > self.limits[at])
        return at


def _units(codes: np.ndarray) -> np.ndarray:
    v = codes.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def grow(codes: np.ndarray, depth: int, seed: int) -> Tree:
    """Each node parts its share of ``codes`` at the median of a direction between two of them."""
    rng, unit = np.random.default_rng(seed), _units(codes)
    directions, limits = np.zeros(((1 << depth) - 1, codes.shape[1]), np.float32), np.zeros((1 << depth) - 1, np.float32)
    shares = [np.arange(len(codes))]
    for i in range(len(limits)):
        share = shares[i]
        if len(share) > 1:
            a, b = rng.choice(share, 2, False)
            directions[i] = unit[a] - unit[b] if (codes[a] != codes[b]).any() else rng.standard_normal(codes.shape[1])
            side = unit[share] @ directions[i]
            limits[i] = np.median(side)
            shares += [share[side <= limits[i]], share[side > limits[i]]]
        else:
            shares += [share, share]
    return Tree(directions, limits, depth)


def first_offers(nodes: DataFrame, number: int, dims: int, s: Settings) -> DataFrame:
    """Messages between nodes of one leaf of a tree, the nearest there, and between neighbours in random rings.

    The trees are fitted on at most about ``s.fitted`` nodes by hash; every node is dealt to a leaf.  Leaves of more than two
    buckets are dealt out to pieces of about a bucket by hash before they are shuffled.
    """
    most = min(s.fitted, max(1000, (32 << 20) // dims))
    chosen = nodes if number <= most else nodes.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(-(-number // most))) == 0).limit(2 * most)
    seen = np.frombuffer(b"".join(r.code for r in chosen.select("code").collect()), np.int8).reshape(-1, dims)
    depth = int(max(0, min(np.ceil(np.log2(max(number, 1) / s.bucket)), np.floor(np.log2(max(len(seen), 1) / 8)))))
    trees = nodes.sparkSession.sparkContext.broadcast([grow(seen, depth, s.seed + t) for t in range(s.trees)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _matrix(batch.column(1), dims)
            for t, tree in enumerate(trees.value):
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(codes) * s.trees + t, pa.int64()), *batch.columns], ["key", "id", "code"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(key: int, ids: list, codes: list) -> Iterator[pa.RecordBatch]:
            n = len(ids)
            if n < 2:
                return
            q, ids = np.frombuffer(b"".join(codes), np.int8).reshape(-1, dims), np.array(ids, np.int64)
            if key < 0:  # a ring
                step = np.arange(1, min(s.ring, n - 1) + 1)
                dst = np.repeat(np.arange(n), len(step))
                src = (dst + np.tile(step, n)) % n
                dst, src = np.concatenate([dst, src]), np.concatenate([src, dst])
                sims = paired(q, dst, src)
            else:
                cross = similarity(q, q)
                np.fill_diagonal(cross, NONE)
                m = min(s.degree // 2, n - 1)
                near = np.argpartition(-cross, m - 1, axis=1)[:, :m]
                dst, src = np.repeat(np.arange(n), m), near.ravel()
                sims = cross[dst, src]
            yield _messages(OFFER, ids[dst], ids[src], sims, np.full(len(dst), NONE), np.ones(len(dst), bool), q[src])

        now, ids, codes = None, [], []
        for batch in batches:
            for key, part, i, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != now or len(ids) >= 4 * s.bucket:
                    if now:
                        yield from piece(now[0], ids, codes)
                    now, ids, codes = (key, part), [], []
                ids.append(i)
                codes.append(code)
        if now:
            yield from piece(now[0], ids, codes)

    dealt = materialize(bounded(nodes.select("id", "code")).mapInArrow(keys, "key long, id long, code binary"), "ann-keys")
    crowded = dealt.groupBy("key").count().where(F.col("count") > 2 * s.bucket).select("key", F.ceil(F.col("count") / s.bucket).alias("pieces"))
    crowded = materialize(crowded, "ann-crowded")  # at most number * trees / (2 * bucket) rows
    if crowded.count() <= 100_000:
        crowded = F.broadcast(crowded)
    part = F.coalesce(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.col("pieces")), F.lit(0).cast("long"))
    leaves = dealt.join(crowded, "key", "left").select("key", part.alias("part"), "id", "code")
    groups = max(1, number // s.bucket)
    rings = [nodes.select(F.lit(-1 - r).cast("long").alias("key"), F.pmod(F.xxhash64("id", F.lit(s.seed + 1 + r)), F.lit(groups)).cast("long").alias("part"), "id", "code") for r in range(s.rings)]
    for r in rings:
        leaves = leaves.unionByName(r)
    return leaves.repartition("key", "part").sortWithinPartitions("key", "part", F.xxhash64("id", "key"), "id").mapInArrow(pairs, ROW)


# rounds

class Rows:
    """Columns of rows sorted by dst, kind and rank; every dst begins with its node."""

    def __init__(self, parts: dict[str, np.ndarray], lists: list[bytes]):
        self.parts, self.lists = parts, lists

    @classmethod
    def read(cls, batch: pa.RecordBatch, dims: int) -> Rows:
        parts = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(("dst", "kind", "src", "sim", "floor", "fresh"))}
        return cls(parts | {"code": _matrix(batch.column(6), dims)}, batch.column(7).drop_null().to_pylist())

    def __len__(self) -> int:
        return len(self.parts["dst"])

    def take(self, where, lists: list[bytes]) -> Rows:
        return Rows({n: c[where] for n, c in self.parts.items()}, lists)

    def join(self, other: Rows) -> Rows:
        return Rows({n: np.concatenate([c, other.parts[n]]) for n, c in self.parts.items()}, self.lists + other.lists)

    def read_part(self, most: int) -> Rows:
        """Without the messages of a kind beyond the first ``most`` of a node."""
        place = _place(self.parts["dst"] * 4 + self.parts["kind"])
        return self.take(place < most, self.lists)


def whole_groups(batches: Iterator[pa.RecordBatch], dims: int, most: int) -> Iterator[Rows]:
    """Batches dealt anew, so that a node and its messages are in one; an unfinished node is held back."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = Rows.read(batch, dims)
        rows = (held.join(rows) if held else rows).read_part(most)
        heads = np.flatnonzero(rows.parts["kind"] == NODE)
        if len(heads) > 1:
            yield rows.take(slice(0, heads[-1]), rows.lists[:-1])
            rows = rows.take(slice(heads[-1], None), rows.lists[-1:])
        held = rows
    if held:
        yield held


def _thinned(dst: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Indices of at most ``most`` messages to each ``dst``, those of least rank."""
    order = np.lexsort((rank, dst))
    return order[_place(dst[order]) < most]


def one_round(now: DataFrame, dims: int, s: Settings, turn: int, last: bool) -> DataFrame:
    """Nodes with their messages (ROW) to the nodes with better lists, and the messages of the next round.

    The last round sends nothing and adds back links to the lists.
    """
    kind, wide = entry(dims), s.degree * 2 if last else s.degree

    def improve(rows: Rows) -> Iterator[pa.RecordBatch]:
        p = rows.parts
        head = p["kind"] == NODE
        me, my_code, group = p["dst"][head], p["code"][head], np.cumsum(head) - 1
        n = len(me)
        mine = np.frombuffer(b"".join(rows.lists), kind)
        counts = np.array([len(x) // kind.itemsize for x in rows.lists])
        g = np.concatenate([np.repeat(np.arange(n), counts), group[~head]])
        ids, sims = np.concatenate([mine["id"], p["src"][~head]]), np.concatenate([mine["sim"], p["sim"][~head]])
        floors, fresh = np.concatenate([mine["floor"], p["floor"][~head]]), np.concatenate([mine["fresh"], np.ones((~head).sum(), bool)])
        codes, known = np.concatenate([mine["code"], p["code"][~head]]), np.r_[np.ones(len(mine), bool), np.zeros((~head).sum(), bool)]
        # equal ids of a node have equal similarities, so they stand together; the list's own entry comes first
        order = np.lexsort((~known, ids, -sims, g))
        order = order[ids[order] != me[g[order]]]
        first = np.r_[True, (g[order][1:] != g[order][:-1]) | (ids[order][1:] != ids[order][:-1])][: len(order)]
        if len(order):
            floors = np.maximum.reduceat(floors[order], np.flatnonzero(first))
        order = order[first]
        keep = _place(g[order]) < wide
        order, floors = order[keep], floors[keep] if len(order) else floors[:0]
        g, ids, sims, fresh, codes, known = (x[order] for x in (g, ids, sims, fresh, codes, known))
        changed, size = np.bincount(g, ~known, n).astype(np.int64), np.bincount(g, minlength=n)
        floor = np.full(n, NONE)
        ends = np.cumsum(size)
        full = size >= s.degree
        floor[full] = sims[ends[full] - 1]
        told = fresh
        if not last:
            by = np.lexsort((_mix(me[g], ids, turn), ~fresh, g))
            say = np.sort(by[_place(g[by] * 2 + fresh[by]) < s.sample])
            told = fresh.copy()
            told[say] = False
            # back links: the chosen neighbours hear of this node
            heard = say[_thinned(ids[say], _mix(ids[say], me[g[say]], turn), 8)]
            yield _messages(BACK, ids[heard], me[g[heard]], sims[heard], floor[g[heard]], fresh[heard], my_code[g[heard]])
            # the local join: chosen neighbours and nodes that list this one
            back = np.flatnonzero(p["kind"] == BACK)
            back = back[_place(group[back]) < 2 * s.sample]
            mg, mid = np.concatenate([g[say], group[back]]), np.concatenate([ids[say], p["src"][back]])
            mnew, mfloor = np.concatenate([fresh[say], p["fresh"][back]]), np.concatenate([floors[say], p["floor"][back]])
            mcode = np.concatenate([codes[say], p["code"][back]])
            by = np.lexsort((~mnew, mid, mg))
            by = by[np.r_[True, (mg[by][1:] != mg[by][:-1]) | (mid[by][1:] != mid[by][:-1])][: len(by)]]
            yield from propose(mg[by], mid[by], mnew[by], mfloor[by], mcode[by], n)
        out = np.zeros(len(ids), kind)
        for name, column in (("id", ids), ("sim", sims), ("floor", floors), ("fresh", told), ("code", codes)):
            out[name] = column
        lists = [out[a:b].tobytes() for a, b in zip(ends - size, ends, strict=True)]
        zero = np.zeros(n)
        yield pa.RecordBatch.from_arrays([pa.array(me), pa.array(np.full(n, NODE, np.int32)), pa.array(changed), pa.array(zero), pa.array(zero), pa.array(zero > 0), _binary(my_code), _column(lists)], schema=_ROW)

    def propose(g, ids, new, floors, codes, n) -> Iterator[pa.RecordBatch]:
        place = _place(g)
        for a in range(0, n, 256):
            b = slice(*np.searchsorted(g, (a, a + 256)))
            if b.start == b.stop:
                continue
            row, col = g[b] - a, place[b]
            shape = (row.max() + 1, col.max() + 1)
            if shape[1] < 2:
                continue
            at, is_new, there = np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
            at[row, col], is_new[row, col], there[row, col] = np.arange(b.start, b.stop), new[b], True
            cross = similarity(codes[at], codes[at])
            cross[~((is_new[:, :, None] | is_new[:, None, :]) & there[:, :, None] & there[:, None, :])] = NONE
            cross[:, np.arange(shape[1]), np.arange(shape[1])] = NONE
            m = min(s.offers, shape[1] - 1)
            near = np.argpartition(-cross, m - 1, axis=2)[:, :, :m]
            value = np.take_along_axis(cross, near, 2)
            r, c, k = np.nonzero(value > np.maximum(floors[at], -1.5)[:, :, None])
            dst, src, value = at[r, c], at[r, near[r, c, k]], value[r, c, k]
            # a pair may come from several nodes: once is enough
            by = np.lexsort((ids[src], ids[dst]))
            by = by[np.r_[True, (ids[dst[by]][1:] != ids[dst[by]][:-1]) | (ids[src[by]][1:] != ids[src[by]][:-1])][: len(by)]]
            by = by[_thinned(ids[dst[by]], -value[by], s.inbox)]
            dst, src = dst[by], src[by]
            yield _messages(OFFER, ids[dst], ids[src], value[by], floors[src], np.ones(len(by), bool), codes[src])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, dims, s.inbox * 2):
            yield from improve(rows)

    # the best offers come first, back links in a random order
    rank = F.when(F.col("kind") == OFFER, -F.col("sim")).otherwise(F.xxhash64("dst", "src", F.lit(turn)).cast("double"))
    dealt = now.repartition("dst").sortWithinPartitions("dst", "kind", rank, "src")
    return bounded(dealt, ROWS).mapInArrow(run, ROW)


def coded(rows: DataFrame) -> DataFrame:
    """(id, v) with the vector's ``code``."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.tobytes() for c in _codes(_tame(_vectors(batch.column(1))))] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(codes)], ["id", "v", "code"])

    return bounded(rows.select("id", "v")).mapInArrow(code, "id long, v array<double>, code binary")


def build(nodes: DataFrame, dims: int, s: Settings = Settings()) -> DataFrame:
    """(id, code), distinct codes, to the graph (id, code, lists), written to the shared folder.  ``lists`` packs entries."""
    nodes = materialize(nodes.select("id", "code"), "ann-nodes")
    number = nodes.count()
    offers = first_offers(nodes, number, dims, s)
    empty = nodes.select(
        F.col("id").alias("dst"), F.lit(NODE).alias("kind"), F.lit(0).cast("long").alias("src"), F.lit(0.0).alias("sim"), F.lit(0.0).alias("floor"), F.lit(False).alias("fresh"), "code", F.expr("X''").alias("lists"))
    now, turn, last = materialize(empty.unionByName(offers), "ann-round", CODEC), 0, False
    while True:
        before, now = now, materialize(one_round(now, dims, s, turn, last), "ann-round", CODEC)
        discard(before)
        _forget(nodes.sparkSession)
        found = now.where(F.col("kind") == NODE)
        if last:
            return found.select(F.col("dst").alias("id"), "code", "lists")
        changed = found.agg(F.sum("src")).first()[0] or 0
        turn, last = turn + 1, turn > 1 and changed <= s.settled * number * s.degree


def _forget(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of rounds that are done: it does so only for plans that were collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


POOL = "q long, code binary, ids binary, sims binary, done binary, open int"


def search(graph: DataFrame, queries: DataFrame, dims: int, s: Settings = Settings(), k: int | None = None) -> DataFrame:
    """(query node) to (node, found): the best nodes that greedy search met, the query's own among them.

    ``graph``: from ``build``; ``queries``: ids of its nodes.  With ``k``, nodes go that cannot hold one
    of the k nearest: rounding turns each of two vectors by ``turned`` at most.
    """
    width, kind = s.pool, entry(dims)
    turned = float(np.arcsin(min(1.0, 0.5 * np.sqrt(dims) / 127)))

    def pooled(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(_column([x[i] for x in out]) for i in range(1, 5)), pa.array([x[5] for x in out], pa.int32())], ["q", "code", "ids", "sims", "done", "open"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for me, code, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = np.frombuffer(lists, kind)[:width]
                out.append((me, code, near["id"].tobytes(), near["sim"].tobytes(), bytes(len(near)), len(near)))
            yield pooled(out)

    def chosen(done: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~done)[: s.beam]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            q, node, code, floor = [], [], [], []
            for me, c, ids, sims, done in zip(rows["q"], rows["code"], rows["ids"], rows["sims"], rows["done"], strict=True):
                sims = np.frombuffer(sims)
                take = np.frombuffer(ids, np.int64)[chosen(np.frombuffer(done, bool))]
                q += [me] * len(take)
                node += take.tolist()
                code += [c] * len(take)
                floor += [float(sims[-1]) if len(sims) >= width else NONE] * len(take)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(node, pa.int64()), _column(code), pa.array(floor, pa.float64())], ["q", "node", "q_code", "floor"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, asked = [], _matrix(batch.column(1), dims)
            for q, code, floor, lists in zip(batch.column(0).to_pylist(), asked, batch.column(2).to_pylist(), batch.column(3), strict=True):
                near = np.frombuffer(lists.as_buffer(), kind)
                if len(near):
                    sims = similarity(near["code"], code[None])[:, 0]
                    good = (sims > floor) & (near["id"] != q)
                    out.append((q, near["id"][good].tobytes(), sims[good].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), _column([x[1] for x in out]), _column([x[2] for x in out])], ["q", "new_ids", "new_sims"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for q, c, ids, sims, done, new_ids, new_sims in zip(*(rows[n] for n in ("q", "code", "ids", "sims", "done", "new_ids", "new_sims")), strict=True):
                ids, sims, done = np.frombuffer(ids, np.int64), np.frombuffer(sims), np.frombuffer(done, bool).copy()
                done[chosen(done)] = True
                more, more_sims = np.frombuffer(b"".join(new_ids or []), np.int64), np.frombuffer(b"".join(new_sims or []))
                all_ids, all_sims, all_done = np.concatenate([ids, more]), np.concatenate([sims, more_sims]), np.concatenate([done, np.zeros(len(more), bool)])
                _, one = np.unique(all_ids, return_index=True)
                order = one[np.lexsort((all_ids[one], -all_sims[one]))][:width]
                out.append((q, c, all_ids[order].tobytes(), all_sims[order].tobytes(), all_done[order].tobytes(), int((~all_done[order]).sum())))
            yield pooled(out)

    begun = graph.join(queries.select("id").distinct(), "id", "left_semi").select("id", "code", "lists")
    pool = materialize(bounded(begun).mapInArrow(start, POOL), "ann-pool")
    lists = graph.select(F.col("id").alias("node"), "lists")
    while front_rows := pool.agg(F.sum(F.least("open", F.lit(s.beam)))).first()[0]:
        front = bounded(pool.where("open > 0")).mapInArrow(expand, "q long, node long, q_code binary, floor double")
        if front_rows * (dims + 40) <= FRONT_BYTES:
            front = F.broadcast(front)
        found = front.join(lists, "node").select("q", "q_code", "floor", "lists").mapInArrow(meet, "q long, new_ids binary, new_sims binary")
        # at most ``beam`` lists reach a query
        found = found.groupBy("q").agg(F.collect_list("new_ids").alias("new_ids"), F.collect_list("new_sims").alias("new_sims"))
        old, pool = pool, materialize(pool.join(found, "q", "left").mapInArrow(merge, POOL), "ann-pool")
        discard(old)
        _forget(graph.sparkSession)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            q, found = [], []
            for me, ids, sims in zip(rows["q"], rows["ids"], rows["sims"], strict=True):
                ids, angles = np.frombuffer(ids, np.int64), np.arccos(np.clip(np.frombuffer(sims), -1, 1))
                # 1e-6: for the rounding of angles near zero
                keep = angles <= angles[k - 1] + 4 * turned + 1e-6 if k and len(ids) > k else slice(None)
                ids = [me, *ids[keep].tolist()]
                q += [me] * len(ids)
                found += ids
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64())], ["node", "found"])

    return pool.mapInArrow(best, "node long, found long")


#: Vectors of a code from which it is met in blocks; vectors, and queries, of such a block; bytes of queries that are scanned at once.
CROWD, BLOCK, SCAN_BYTES = 64, 512, 8 << 20


def _rank(part: str, *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(part).orderBy(*order))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two tables in double precision, each as the same sum of products wherever it is computed."""
    a, b = _tame(a), _tame(b)
    return np.einsum("id,jd->ij", a, b) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _met(asked: DataFrame, met: DataFrame, reps: DataFrame, node_of: DataFrame, dims: int, k: int) -> DataFrame:
    """(rep, vec_id, score) of the vectors of all nodes that the queries met.

    Vectors of a code that many share are met in blocks: such a block multiplies its queries with its vectors and returns
    each query's k + 1 best, so a crowd's pairs are no rows and no task gets them all.
    """
    held = reps.join(node_of, "code").select(F.col("node").alias("near"), F.col("v").alias("b"), "ids")
    pairs = materialize(asked.join(met, "node").select("rep", "a", "near"), "ann-met")
    crowds = held.groupBy("near").agg(F.count(F.lit(1)).alias("vectors")).where(F.col("vectors") > CROWD)
    crowds = crowds.join(pairs.groupBy("near").agg(F.count(F.lit(1)).alias("queries")), "near")
    crowds = materialize(crowds.select("near", F.ceil(F.col("vectors") / BLOCK).alias("pieces"), F.ceil(F.col("queries") / BLOCK).alias("parts")), "ann-crowds")
    wide = F.broadcast(crowds) if crowds.count() <= 100_000 else crowds

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_tame(_vectors(batch.column(i)).reshape(len(batch), dims)) if len(batch) else np.zeros((0, 1)) for i in (2, 3))
            cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["rep", "ids", "score"])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        reps, lists = left["rep"].to_numpy(), right["ids"].to_pylist()
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            cosine = _cosines(*(_vectors(t[c].combine_chunks()) for t, c in ((left, "a"), (right, "b"))))
            ids, of = np.concatenate([np.array(x, np.int64) for x in lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            for rep, row in zip(reps.tolist(), cosine, strict=True):
                score, seen = row[of], set()
                for j in np.lexsort((ids, -score)):
                    if ids[j] not in seen:
                        seen.add(ids[j])
                        found.append((rep, int(ids[j]), float(score[j])))
                        if len(seen) > k:
                            break
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("rep", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    single = pairs.join(wide.select("near"), "near", "left_anti").join(held, "near").select("rep", "ids", "a", "b")
    scored = bounded(single).mapInArrow(exact, "rep long, ids array<long>, score double").select("rep", F.explode("ids").alias("vec_id"), "score")
    if crowds.isEmpty():
        return scored
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = pairs.join(wide, "near").select("rep", "a", "near", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), every("pieces").alias("piece"))
    right = held.join(wide, "near").select("b", "ids", "near", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece"), every("parts").alias("part"))
    key = ["near", "part", "piece"]
    return scored.unionByName(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block, "rep long, vec_id long, score double"))


def _scanned(asking: DataFrame, rows: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): exact answers for ids with several vectors, of which the nearest counts, from every row."""
    number = asking.count()
    blocks = -(-number * dims * 8 // SCAN_BYTES)

    def part(i: int) -> DataFrame:
        chosen = asking.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        sent = asking.sparkSession.sparkContext.broadcast((chosen["query_id"].to_numpy(), _vectors(chosen["v"].combine_chunks()).reshape(-1, dims)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, vectors = sent.value
            best: dict[int, dict[int, float]] = {int(q): {} for q in own}
            for batch in batches:
                if not len(batch) or not len(own):
                    continue
                ids = batch.column(0).to_numpy()
                cosine = _cosines(vectors, _vectors(batch.column(1)).reshape(-1, dims))
                for q in best:
                    score, held, seen = cosine[own == q].max(0), best[q], set()
                    for j in np.lexsort((ids, -score)):
                        i = int(ids[j])
                        if i != q and i not in seen:
                            seen.add(i)
                            held[i] = max(held.get(i, NONE), float(score[j]))
                            if len(seen) == k:
                                break
                    best[q] = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k])
            found = [(q, i, v) for q, held in best.items() for i, v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        return materialize(bounded(rows.select("id", "v")).mapInArrow(run, "query_id long, vec_id long, score double"), "ann-scanned")

    out = part(0)
    for i in range(1, blocks):
        out = out.unionByName(part(i))
    return out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For each row for which ``is_query`` (of the column ``id``) holds, its ``k`` nearest other rows:
    query_id, rank (from 1), vec_id, score.  Nearest first, ties to the smaller id.

    Rows whose id or vector is null, or whose vector is empty, zero, or holds null or non-finite components take no
    part, nor do vectors of another length than most; vectors of any length and size of components are read whole.
    For equal vectors the k + 1 smallest ids stand: no result can hold more of them.  Rows that repeat an id and its
    vector count once.  Of an id that repeats with other vectors the nearest counts, on either side, and an id is never
    its own neighbour; queries of such ids are answered by a scan of all rows.  Fewer candidates than ``k`` give fewer ranks; an empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    rows = materialize(coded(usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"])), "ann-vectors")
    head = rows.select(F.size("v").alias("d")).first()
    if not head:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = head["d"]
    # distinct vectors with their smallest ids: a window's limit holds before its shuffle, so a very common vector stays small
    few = rows.withColumn("place", _rank("v", "id")).where(F.col("place") <= k + 1)
    reps = few.groupBy("v", "code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    reps = materialize(reps.select("v", "code", "ids", F.get("ids", 0).alias("rep")), "ann-reps")
    node_of = materialize(reps.groupBy("code").agg(F.min("rep").alias("node")), "ann-codes")
    graph = build(node_of.select(F.col("node").alias("id"), "code"), dims, settings)
    asking = rows.where(is_query).select(F.col("id").alias("query_id"), "v")
    many = materialize(asking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id"), "ann-repeated")
    several = None if many.isEmpty() else materialize(asking.join(many, "query_id"), "ann-several")
    asking = asking if several is None else asking.join(many, "query_id", "left_anti")
    # each different vector is searched once
    asked = asking.groupBy("v").agg(F.count(F.lit(1)).alias("rows")).join(reps, "v").join(node_of, "code").select("rep", "node", "rows", F.col("v").alias("a"))
    asked = materialize(asked, "ann-asked")
    met = search(graph, asked.select(F.col("node").alias("id")), dims, settings, k).withColumnRenamed("found", "near")
    scored = _met(asked, met, reps, node_of, dims, k).groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    # a query's own id is one of the k + 1, if it is among them at all
    top = scored.withColumn("place", _rank("rep", F.desc("score"), "vec_id")).where(F.col("place") <= k + 1)
    answers = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    answers = materialize(asked.join(answers, "rep").select(F.col("a").alias("v"), "rows", "best"), "ann-answers")
    told = skewed_join(asking, answers, "v", "rows")
    others = told.select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    out = others.select("query_id", F.posexplode("best").alias("at", "x"))
    out = out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    if several is None:
        return out
    scanned = _scanned(several, rows, dims, k).withColumn("rank", _rank("query_id", F.desc("score"), "vec_id")).where(F.col("rank") <= k)
    return out.unionByName(scanned.select("query_id", "rank", "vec_id", "score"))
