"""Embedding near-dedup: sorted projection passes find linked vectors, which are united across passes and then counted.

Each pass orders the vectors by the signs of its own random projections and compares those in bounded neighbouring windows.
What the passes unite is then counted in full: a vector whose angle to the centre of its component, together with the
largest such angle, stays within the threshold is linked to all the others without looking at any; the rest are compared in
blocks. No pair is written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import number_rows
from ..session import cut
from ._text import on_batches
from .components import components

PASSES, SIGNS = 16, 24
WINDOW = 128  # neighbours on each side that are compared at least
BLOCK = 256
SEED = 20


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by length of its vectors."""
    sizes = np.array([len(x) for x in batch.column("_v")])
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def _codes(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """The sign bits of ``SIGNS`` random projections of each vector, for each pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in _by_size(whole):
                m = _unit(_matrix(batch.column("_v")))
                n = m.shape[1]
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, passes * SIGNS))
                bits = (m @ planes[n] > 0).reshape(len(m), passes, SIGNS)
                codes = bits @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_node").take(pa.array(np.repeat(np.arange(len(m)), passes))),
                    pa.array(np.repeat(np.array(batch.column("_label").to_pylist(), np.int64), passes)), pa.array(np.full(len(m) * passes, n, np.int32)),
                    pa.array(np.tile(np.arange(passes, dtype=np.int32), len(m))), pa.array(codes.ravel())], ["_node", "_label", "_size", "_pass", "_code"])
    return on_batches(rows.select("_node", "_label", "_v"), run, "_node binary, _label long, _size int, _pass int, _code long")


def _roots(alike: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches through likeness."""
    root = np.arange(len(alike))
    while True:
        low = np.where(alike, root[None, :], len(alike)).min(1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _candidates(nodes: DataFrame, threshold: float, passes: int, seed: int) -> DataFrame:
    """Links that tie together what neighbouring windows hold, each node to the smallest it reaches there."""
    ranked = number_rows(_codes(nodes, passes, seed), ["_code", "_node"], by=["_pass", "_label", "_size"], name="_no")
    at = F.floor((F.col("_no") - 1) / BLOCK)
    tail = F.when((F.pmod(F.col("_no") - 1, F.lit(BLOCK)) < WINDOW) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    placed = ranked.select("_node", "_pass", "_label", "_size", F.explode(tail).alias("_at"))
    both = placed.join(nodes.select("_node", "_v"), "_node")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("_node").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        m = _unit(_matrix(table.column("_v")))[order]
        root = _roots(m @ m.T >= threshold)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array([ids[order[i]] for i in moved], pa.binary()), pa.array([ids[order[root[i]]] for i in moved], pa.binary())], ["a", "b"])
    found = both.groupBy("_pass", "_label", "_size", "_at").applyInArrow(compare, "a binary, b binary")
    return cut(found.distinct(), "candidates")


def _angles(members: DataFrame) -> DataFrame:
    """Each member's angle to the centre of its component."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, m = np.array(batch.column("label").to_pylist(), object), [np.array(v, float) for v in batch.column("_v").to_pylist()]
            kinds, back = np.unique(labels, return_inverse=True)
            sums = [_unit(np.array([m[i] for i in np.flatnonzero(back == k)])).sum(0) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.tolist(), pa.binary()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["label", "sum"])
    partial = on_batches(members.select("label", "_v"), add, "label binary, sum array<double>")
    summed = partial.select("label", F.posexplode("sum")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    centre = summed.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("_c"))
    both = members.join(cut(centre, "centres"), "label")

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = [math.acos(max(-1.0, min(1.0, float(_unit(np.array([v], float))[0] @ _unit(np.array([c], float))[0]))))
                    if any(c) else math.pi for v, c in zip(batch.column("_v").to_pylist(), batch.column("_c").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_node"), pa.array(turn, pa.float64())], ["label", "_node", "_angle"])
    return cut(on_batches(both.select("label", "_node", "_v", "_c"), angle, "label binary, _node binary, _angle double"), "angles")


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """How many vectors each member is linked to, copies of its own vector left out."""
    limit = math.acos(threshold) - 1e-9
    angles = _angles(members)
    facts = members.groupBy("label").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_all"))
    facts = facts.join(angles.groupBy("label").agg(F.max("_angle").alias("_widest")), "label")
    known = members.join(angles.select("_node", "_angle"), "_node").join(cut(facts, "facts"), "label")
    known = cut(known.withColumn("_sure", F.col("_angle") + F.col("_widest") <= limit), "members")
    sure = known.filter("_sure").select("_node", (F.col("_all") - F.col("_n")).alias("_links"))

    unsure = known.filter("not _sure").groupBy("label").agg(F.count(F.lit(1)).alias("_u"))
    rest = known.join(cut(unsure, "unsure"), "label")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n, salt: F.pmod(F.xxhash64("_node", F.lit(salt)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    seekers = rest.filter("not _sure").select("label", mine("_u", 1).alias("_i"), every("_m").alias("_j"), "_node", "_n", "_v", F.lit(True).alias("_seeks"))
    targets = rest.select("label", every("_u").alias("_i"), mine("_m", 2).alias("_j"), "_node", "_n", "_v", F.lit(False).alias("_seeks"))

    def count(table: pa.Table) -> pa.Table:
        seeks = np.array(table.column("_seeks").to_pylist(), bool)
        ids = np.array(table.column("_node").to_pylist(), object)
        m, n = _unit(_matrix(table.column("_v"))), table.column("_n").to_numpy()
        alike = (m[seeks] @ m[~seeks].T >= threshold) & (ids[seeks][:, None] != ids[~seeks][None, :])
        return pa.table([pa.array(ids[seeks].tolist(), pa.binary()), pa.array((alike * n[~seeks][None, :]).sum(1).astype(np.int64))], ["_node", "_links"])
    counted = seekers.unionByName(targets).groupBy("label", "_i", "_j").applyInArrow(count, "_node binary, _links long")
    return sure.unionByName(counted.groupBy("_node").agg(F.sum("_links").alias("_links")))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked when their labels are equal and not NULL, they have as many components and their cosine is at least
    ``threshold`` (between 0 and 1). A row whose id, label or vector is NULL, or whose vector is empty, zero or holds a NULL or non-finite
    component, is linked to nothing and is a component of its own. Rows that repeat id, label and vector are one vector; of
    vectors that share an id each has its own links.

    Equal vectors are one node from the start, with the number of ids as weight. A link is missed only where no pass brings its
    ends, or others that join them, into one window.
    """
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(F.coalesce(v, F.array())) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    raw = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), v.cast("array<double>").alias("_v"), F.coalesce(fine, F.lit(False)).alias("_fine"))
    hexed = lambda s: F.lpad(F.hex(F.xxhash64(F.lit(s), "_label", "_v")), 16, "0")
    node = F.when(F.col("_fine"), F.unhex(F.concat(hexed(1), hexed(2))))
    rows = raw.withColumn("_node", node)
    light = cut(rows.groupBy("_id", "_node").agg(F.count(F.lit(1)).alias("_copies")), "rows")
    sizes = light.filter("_node is not null").groupBy("_node").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    held = rows.filter("_fine").groupBy("_node").agg(F.first("_label").alias("_label"), F.first("_v").alias("_v"))
    nodes = cut(held.join(sizes, "_node"), "nodes")

    labels = components(_candidates(nodes.select("_node", "_label", "_v"), threshold, passes, seed))
    members = cut(nodes.join(labels, F.col("_node") == F.col("node")).select("label", "_node", "_n", "_v"), "grouped")
    links = cut(_counts(members, threshold), "links")
    firsts = nodes.join(labels, F.col("_node") == F.col("node")).groupBy("label").agg(F.min("_first").alias("_least"))
    named = labels.join(cut(firsts, "firsts"), "label").select(F.col("node").alias("_node"), "_least")
    facts = nodes.select("_node", "_first", "_n").join(links, "_node", "left").join(named, "_node", "left").select(
        F.col("_node").alias("_k"), (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).cast("long").alias("_links"), F.coalesce("_least", "_first").alias("_least"))
    out = light.join(cut(facts, "facts"), F.col("_node") == F.col("_k"), "left")
    own = F.coalesce("_least", "_id")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"), copy).drop("_copy")
