"""A Merkle manifest of a dataset, kept in an external-memory node store.

Leaves are range-partitioned and sorted by group and order, so every task streams one sorted run and
numbers its leaves; one offset a run makes the numbers positions in the whole group.  A leaf's
coordinate is (group, position), a node's (group, level, position).  Blocks of 3^7 neighbouring
leaves stream through seven levels, each of which reads the one below in order, and go to Parquet
partitioned by level; the highest level is the next pass's leaves, until one block is left for each
group.  The groups' roots make one more such tree.

Proofs come from the top down: the leaves of a block, the stored nodes of its inner levels and the
proof of its top meet by coordinate and are scanned side by side.  No task sees more than a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.storage import materialize, scratch_path

FANOUT, LEVELS = 3, 7
BLOCK = FANOUT**LEVELS
#: The level under which the store keeps what remains of a group: its root, as position 0.
TOP = -1
NODE = "level int, grp {g}, pos long, hash string"
PROOF = "array<struct<left: string, right: string>>"


def _sha256(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def field(c: Column) -> Column:
    """A value as the leaf's digest reads it: its UTF-8 length, a colon, itself; ``-`` if it is null."""
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


@dataclass(frozen=True)
class Forest:
    """One tree for each value of ``grp``: leaves with coordinates, group sizes, stored nodes of every pass."""

    leaves: DataFrame  # grp, pos, hash and the leaves' own columns
    sizes: DataFrame  # grp, n
    passes: tuple[DataFrame, ...]  # level, grp, pos, hash: levels 1 to 7 above the pass's leaves, and TOP

    @property
    def tops(self) -> DataFrame:
        """(grp, hash): the root of every group."""
        found = [p.where(F.col("level") == TOP).select("grp", "hash") for p in self.passes]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]


def _number(rows: DataFrame) -> DataFrame:
    """``rows`` with _at: how many rows of the same run and group stand before this one."""

    def run(batches):
        last, at = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("grp"))
            ends = np.asarray(runs.run_ends, np.int64)
            if len(ends):
                starts = np.concatenate([[0], ends[:-1]])
                number = np.arange(len(batch)) - np.repeat(starts, ends - starts)
                if last is not None and last == (runs.values[0].as_py(),):
                    number[: ends[0]] += at
                last, at = (runs.values[-1].as_py(),), int(number[-1]) + 1
                yield batch.append_column("_at", pa.array(number, pa.int64()))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return bounded(rows).mapInArrow(run, f"{kinds}, _at long")


def place(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with pos, their place in their ``grp`` by ``order`` (nulls first), and (grp, n)."""
    sort = ["grp", *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_run", F.spark_partition_id())
    runs = materialize(_number(ranged), "merkle-runs")
    counts = runs.groupBy("_run", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    # only a run's first group can have begun in an earlier run: a row for each run at most
    starts = counts.select("_run", "grp", F.sum("n").over(before).alias("_before")).where("_before > 0").select(F.col("_run").alias("_r"), F.col("grp").alias("_g"), "_before")
    placed = runs.join(F.broadcast(starts), (runs["_run"] == F.col("_r")) & runs["grp"].eqNullSafe(F.col("_g")), "left")
    placed = placed.withColumn("pos", F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_at", "_before", "_run", "_r", "_g")
    return placed, materialize(counts.groupBy("grp").agg(F.sum("n").alias("n")), "merkle-sizes")


def _blocks(sizes: DataFrame) -> DataFrame:
    """(grp, block, n): every block of every group."""
    return sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))


def grow(leaves: DataFrame, sizes: DataFrame) -> Forest:
    """The trees above numbered leaves, written level by level to the store."""
    spark, kind = leaves.sparkSession, dict(leaves.dtypes)["grp"]
    schema = NODE.format(g=kind)

    def lift(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["n"]))
        whole = head["n"][0].as_py() <= BLOCK  # the group's only block
        below = table.filter(pc.is_null(table["n"])).sort_by("pos")["hash"].to_pylist()
        first, levels, places, hashes = head["block"][0].as_py() * BLOCK, [], [], []
        for level in range(1, LEVELS + 1):
            if whole and len(below) == 1:
                break
            below = [_sha256(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)]
            first //= FANOUT
            levels += [level] * len(below)
            places += range(first, first + len(below))
            hashes += below
        if whole:
            levels, places, hashes = [*levels, TOP], [*places, 0], [*hashes, *below]
        grp = head["grp"].combine_chunks().take(pa.array([0] * len(levels), pa.int32()))
        return pa.table({"level": pa.array(levels, pa.int32()), "grp": grp, "pos": pa.array(places, pa.int64()), "hash": pa.array(hashes, pa.string())})

    passes, now, left = [], leaves.select("grp", "pos", "hash"), sizes
    largest = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        rows = now.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "hash", F.lit(None).cast("long").alias("n"))
        heads = _blocks(left).select("grp", "block", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("hash"), "n")
        nodes = rows.unionByName(heads).groupBy("grp", "block").applyInArrow(lift, schema)
        path = scratch_path(spark, "merkle-nodes")
        nodes.sortWithinPartitions("level", "grp", "pos").write.partitionBy("level").parquet(path)
        passes.append(spark.read.schema(schema).parquet(path))
        if largest <= BLOCK:
            return Forest(leaves, sizes, tuple(passes))
        now = passes[-1].where(F.col("level") == LEVELS).join(left.where(F.col("n") <= BLOCK).select(F.col("grp").alias("_g")), F.col("grp").eqNullSafe(F.col("_g")), "left_anti")
        left = left.where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).alias("n"))
        largest = -(-largest // BLOCK)


def prove(forest: Forest, above: DataFrame) -> DataFrame:
    """The forest's leaves with their proof: for each level the siblings to the left and to the right, concatenated.

    ``above`` (grp, proof) continues the proof of every group's root; its further columns are handed down to the leaves.
    """
    handed = [c for c in above.columns if c not in ("grp", "proof")]
    sizes, levels = forest.sizes, []
    for _ in forest.passes:
        levels.append(sizes)
        sizes = sizes.where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).alias("n"))
    proofs = None
    for k in range(len(forest.passes) - 1, -1, -1):
        single = levels[k].where(F.col("n") <= BLOCK).select(F.col("grp").alias("_g"))
        heads = above.join(single, above["grp"].eqNullSafe(single["_g"]), "left_semi").select("grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), "proof", *handed)
        if proofs is not None:
            heads = heads.unionByName(proofs.select("grp", F.col("pos").alias("block"), F.lit(False).alias("whole"), "proof", *handed))
        leaves = forest.leaves if k == 0 else forest.passes[k - 1].where(F.col("level") == LEVELS).select("grp", "pos", "hash")
        if k > 0:
            leaves = leaves.join(levels[k].select(F.col("grp").alias("_g")), F.col("grp").eqNullSafe(F.col("_g")), "left_semi")
        proofs = materialize(_scan(leaves, forest.passes[k], heads, handed), "merkle-proofs")
    return proofs


def _scan(leaves: DataFrame, nodes: DataFrame, heads: DataFrame, handed: list[str]) -> DataFrame:
    """The leaves of one pass with the proofs that ``heads`` (grp, block, whole, proof) continues."""
    own = [c for c in leaves.columns if c not in ("grp", "pos", "hash")]

    def at(df: DataFrame, level: Column, width: Column) -> DataFrame:
        return df.select("grp", F.floor(F.col("pos") / width).alias("block"), level.cast("int").alias("level"), *[F.col(c) for c in df.columns if c not in ("grp", "level")])

    inner = nodes.where((F.col("level") > 0) & (F.col("level") < LEVELS))
    heads = heads.withColumn("level", F.lit(LEVELS))
    rows = (
        at(leaves, F.lit(0), F.lit(BLOCK))
        .unionByName(at(inner, F.col("level"), F.pow(F.lit(FANOUT), LEVELS - F.col("level"))), allowMissingColumns=True)
        .unionByName(heads, allowMissingColumns=True))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("grp", "pos", "hash", *own, *handed))

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by([("level", "ascending"), ("pos", "ascending")])
        level = table["level"].to_numpy()
        head = table.slice(len(table) - 1)
        hashes = [table["hash"].filter(pa.array(level == k)).to_pylist() for k in range(LEVELS)]
        height = LEVELS
        if head["whole"][0].as_py():
            height = next(k for k in range(LEVELS + 1) if k == LEVELS or len(hashes[k]) == 1)
        top = [(s["left"], s["right"]) for s in head["proof"][0].as_py()]
        paths = [top]
        for k in range(height - 1, -1, -1):
            row, out = hashes[k], []
            for i in range(len(row)):
                first = i - i % FANOUT
                out.append([("".join(row[first:i]), "".join(row[i + 1 : first + FANOUT])), *paths[i // FANOUT]])
            paths = out
        leaf = table.slice(0, len(paths))
        flat = [s for p in paths for s in p]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
        sides = pa.StructArray.from_arrays([pa.array([s[j] for s in flat], pa.string()) for j in (0, 1)], ["left", "right"])
        out = {c: leaf[c] for c in ("grp", "pos", "hash", *own)}
        again = pa.array([0] * len(leaf), pa.int32())
        out |= {c: head[c].combine_chunks().take(again) for c in handed}
        return pa.table(out | {"proof": pa.ListArray.from_arrays(pa.array(ends), sides)})

    return rows.groupBy("grp", "block").applyInArrow(scan, f"{schema}, proof {PROOF}")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, altered: dict[str, Column] | None = None) -> DataFrame:
    """One row for every input row: ``order``, leaf, subroot, root, proof, and the leaf of the altered row if asked.

    A leaf is the digest of ``columns``; leaves of a ``group`` ascend by ``order`` (nulls first, equal ones by digest),
    groups in UTF-8 order, the null group first.  ``altered`` has other values for some columns: the leaf
    they would give is ``altered_leaf``.  Nulls in any column have their own digest; texts of any length are hashed
    whole in the JVM; rows that repeat are leaves of their own.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    changed = altered or {}
    rows = docs.select(
        F.col(group).alias("grp"), F.col(order).alias("_order"), digest([F.col(c) for c in columns]).alias("hash"),
        *([digest([changed.get(c, F.col(c)) for c in columns]).alias("altered_leaf")] if changed else []), F.monotonically_increasing_id().alias("_row"))
    forest = grow(*place(materialize(rows, "merkle-leaves"), ["_order", "hash", "_row"]))
    tops = materialize(forest.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), "merkle-tops")
    crown = grow(*place(tops, ["name"]))
    root = crown.tops.first()
    end = docs.sparkSession.createDataFrame([("", [])], f"grp string, proof {PROOF}")
    above = prove(crown, end).select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "proof")
    out = prove(forest, above)
    return out.select(
        F.col("_order").alias(order), F.col("hash").alias("leaf"), "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"), "proof", *(["altered_leaf"] if changed else []))
