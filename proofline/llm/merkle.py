"""A Merkle manifest of a dataset: a hash tree per group, one tree over the groups, and a witness for every row.

Witnesses are incremental: nodes are appended in order, each joins an open subtree with a partial witness, and every run of
siblings that completes extends the witnesses below it. Tasks append aligned blocks of nodes; the roots of the blocks are
then appended themselves, block by block, until one root is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from ._text import on_batches

RUN = 8  # siblings that are hashed together
LEVELS = 3
BLOCK = RUN ** LEVELS  # nodes a task appends before it passes them on
STEPS = "array<struct<left: binary, right: binary>>"
STEP_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def digest(*values: Column) -> Column:
    """SHA-256 in lower-case hex of the values one after the other: each "-" where NULL, else its length in bytes, ":" and itself."""
    coded = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*coded), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and its witness lead to."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(_hex(s["left"]), at, _hex(s["right"])), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of the siblings (hex) in a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


class Block:
    """The open subtrees of one aligned block. ``open[k]`` holds the nodes of the run not yet complete at level k, each with
    the witnesses of the leaves below it."""

    def __init__(self):
        self.open: list[list[tuple[bytes, list[list]]]] = [[] for _ in range(LEVELS + 1)]
        self.witnesses: list[list[tuple[bytes, bytes]]] = []

    def append(self, node: bytes) -> None:
        witness: list[tuple[bytes, bytes]] = []
        self.witnesses.append(witness)
        self._add(0, node, [witness])

    def _add(self, level: int, node: bytes, below: list[list]) -> None:
        self.open[level].append((node, below))
        if level < LEVELS and len(self.open[level]) == RUN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, below) in enumerate(run):
            step = b"".join(nodes[:i]), b"".join(nodes[i + 1:])
            for witness in below:
                witness.append(step)
        parent = hashlib.sha256(b"".join(nodes).hex().encode()).digest()
        self._add(level + 1, parent, [w for _, below in run for w in below])

    def close(self, only: bool) -> bytes:
        """The block's root. The ``only`` block of a tree ends where one node is left; any other goes up all levels."""
        for level in range(LEVELS):
            alone = len(self.open[level]) == 1 and not any(self.open[level + 1:])
            if only and alone:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
        return self.open[LEVELS][0][0]


def _append(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes appended in order: a row per node with its witness in the block, and one per block with its root."""
    columns = "_tree string, _pos long, _hash binary, _steps " + STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, places, only = None, None, [], True

        def done() -> Iterator[pa.RecordBatch]:
            root = block.close(only)
            tree, number = key
            yield pa.RecordBatch.from_arrays([
                pa.array([tree] * (len(places) + 1), pa.string()), pa.array([*(p for p, _ in places), number], pa.int64()),
                pa.array([*(h for _, h in places), root], pa.binary()), pa.array([*block.witnesses, None], STEP_TYPE)],
                ["_tree", "_pos", "_hash", "_steps"])

        for batch in batches:
            for tree, pos, node, n in zip(*(batch.column(c).to_pylist() for c in ("_tree", "_pos", "_hash", "_n"))):
                if key != (tree, pos // BLOCK):
                    if block:
                        yield from done()
                    key, block, places, only = (tree, pos // BLOCK), Block(), [], n <= BLOCK
                places.append((pos, node))
                block.append(node)
        if block:
            yield from done()

    number = F.floor(F.col("_pos") / BLOCK)
    dealt = nodes.select("_tree", "_pos", "_hash", "_n").repartition(F.col("_tree"), number).sortWithinPartitions("_tree", "_pos")
    return cut(on_batches(dealt, run, columns), "blocks")


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Witnesses (``_tree``, ``_pos``, ``_steps``) of the nodes of each tree, and a root (``_tree``, ``_hash``) per tree.

    ``nodes`` has ``_tree``, ``_pos`` (0, 1, ... within the tree), ``_hash`` and ``_n`` (nodes of the tree).
    """
    appended = _append(nodes)
    found, blocks = appended.filter("_steps is not null"), appended.filter("_steps is null").select("_tree", "_pos", "_hash")
    found = found.select("_tree", "_pos", "_steps")
    if not (blocks.agg(F.max("_pos")).first()[0] or 0):
        return found, blocks.select("_tree", "_hash")
    n = blocks.groupBy("_tree").agg(F.count(F.lit(1)).alias("_n"))
    above, roots = forest(blocks.join(n, "_tree"))
    above = above.select(F.col("_tree"), F.col("_pos").alias("_block"), F.col("_steps").alias("_above"))
    found = found.withColumn("_block", F.floor(F.col("_pos") / BLOCK)).join(above, ["_tree", "_block"])
    return found.select("_tree", "_pos", F.concat("_steps", "_above").alias("_steps")), roots


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_pos``, the place of a row within its ``_tree`` by ``order``, and ``_n``, the rows of the tree.

    Rows are dealt by ranges of (tree, order), rows alike in both by their place in the input; a table of one row per
    range and tree carries the offsets.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("_tree", *order, "_tie")
    ranged = ranged.sortWithinPartitions("_tree", *order, "_tie").drop("_tie")
    ranged = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    totals = ranged.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = W.partitionBy("_tree")
    before = tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_tree", "_part", F.sum("_rows").over(tree).alias("_n"),
                          (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return ranged.join(bases, ["_tree", "_part"]).withColumn("_pos", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def manifest(leaves: DataFrame, id_col: str, group_col: str, leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``steps``, the witness of each row.

    Per group, leaves (hex) ascend by id, NULL ids first, those that share an id by leaf. While several nodes remain, every
    eight consecutive ones, the last run fewer, become the hash of their hex digests. What remains is the subroot; subroots
    ordered by group, NULL first, give the root likewise. A step holds the siblings left and right of the node at one level,
    32 bytes each; a level at which a node has none is a step too. Rows alike in id and leaf may swap places, which changes
    no digest. An empty table has no tree and gives no row. A group of any size is spread over tasks in blocks of 512.
    """
    tree = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    names = [c for c in leaves.columns]
    rows = leaves.select(F.struct(*[F.col(c) for c in names]).alias("_row"), tree.alias("_tree"), F.col(id_col).alias("_id"),
                         F.unhex(leaf_col).alias("_hash"))
    placed = cut(_placed(rows, ["_id", "_hash"]).drop("_id"), "leaves")
    found, subroots = forest(placed)
    tops = cut(_placed(subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_group"), "_hash"), ["_group"]), "subroots")
    above, root = forest(tops)
    upper = tops.select("_tree", "_group", "_pos", F.col("_hash").alias("_subroot")).join(
        above.withColumnRenamed("_steps", "_above"), ["_tree", "_pos"]).join(root.withColumnRenamed("_hash", "_root"), "_tree")
    upper = cut(upper.select(F.col("_group").alias("_tree"), "_subroot", "_above", "_root"), "upper")
    out = placed.select("_tree", "_pos", "_row").join(found, ["_tree", "_pos"]).join(upper, "_tree")
    return out.select("_row.*", _hex("_subroot").alias("subroot"), _hex("_root").alias("root"), F.concat("_steps", "_above").alias("steps"))
