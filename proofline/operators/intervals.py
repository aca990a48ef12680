"""Interval questions without emitting pairs: a running maximum of interval ends answers each of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .numbering import all_of, running_max


def touches(rows: DataFrame, intervals: DataFrame, by: Sequence[str], lo: str, hi: str,
            start: str = "start", end: str = "end", name: str = "touched") -> DataFrame:
    """Flag rows whose [lo, hi] meets any [start, end] of the same key.

    ``max(end) over intervals starting at or before hi`` is at least ``lo`` exactly when one of them meets the
    row. Both sides are first reduced to one row per position, and the maximum runs over ranges that split a
    key with many positions.
    """
    spots = rows.filter(F.col(hi).isNotNull()).select(*by, F.col(hi).cast("long").alias("_pos")).distinct().select(
        *by, "_pos", F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_ask"))
    spans = intervals.groupBy(*by, F.col(start).cast("long").alias("_pos")).agg(
        F.max(F.col(end).cast("long")).alias("_end")).withColumn("_ask", F.lit(0))
    reached = running_max(spots.unionByName(spans), "_end", ["_pos", "_ask"], by, "_reach").filter("_ask = 1")
    reach = reached.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.col("_pos").alias("_rp"), "_reach")
    match = all_of([F.col(c) == F.col(f"_r{i}") for i, c in enumerate(by)]) & (
        F.col(hi).cast("long") == F.col("_rp"))
    joined = rows.join(reach, match, "left")
    hit = F.coalesce(F.col("_reach") >= F.col(lo).cast("long"), F.lit(False))
    return joined.select(*rows.columns, hit.alias(name))


def hunk_footprint(hunks: DataFrame, new_start: str = "new_start", new_len: str = "new_len") -> DataFrame:
    """Changed lines of each hunk as [start, end]; a pure deletion is a point that also touches the line after."""
    first, size = F.col(new_start).cast("long"), F.col(new_len).cast("long")
    return hunks.withColumn("start", first).withColumn(
        "end", F.when(size == 0, first + 1).otherwise(first + size - 1))


def interval_overlap(blocks: DataFrame, hunks: DataFrame, by: Sequence[str] = ("path",), lo: str = "block_start",
                     hi: str = "block_end", name: str = "touched") -> DataFrame:
    return touches(blocks, hunk_footprint(hunks), by, lo, hi, name=name)


def new_side(hunks: DataFrame) -> DataFrame:
    return hunks.filter("new_len > 0").withColumn("start", F.col("new_start").cast("long")).withColumn(
        "end", F.col("new_start").cast("long") + F.col("new_len") - 1)


def old_side(hunks: DataFrame, removed_len: str = "removed_len") -> DataFrame:
    first = F.greatest(F.col("new_start").cast("long"), F.lit(1))
    return hunks.filter(F.col(removed_len) > 0).withColumn("start", first).withColumn(
        "end", first + F.col(removed_len) - 1)


def point_in_interval(points: DataFrame, hunks: DataFrame, by: Sequence[str] = ("path",), line: str = "line",
                      side: str = "new", name: str = "inside") -> DataFrame:
    spans = new_side(hunks) if side == "new" else old_side(hunks)
    return touches(points, spans, by, line, line, name=name)


def anchor_points(points: DataFrame, hunks: DataFrame, changed_paths: DataFrame, version: str | None = None) -> DataFrame:
    """Place each point (path, line, side, version, outdated) against a change set: outdated, path_absent or resolved."""
    differs = F.lit(False) if version is None else F.coalesce(F.col("version") != version, F.lit(False))
    stale = F.col("outdated") | differs | F.col("line").isNull()
    known = changed_paths.select(F.col("path").alias("_known")).distinct()
    flagged = point_in_interval(points, hunks, name="_new")
    flagged = point_in_interval(flagged, hunks, side="old", name="_old")
    flagged = flagged.join(known, F.col("path") == F.col("_known"), "left")
    state = F.when(stale, "outdated").when(F.col("_known").isNull(), "path_absent").otherwise("resolved")
    within = F.when(F.col("side") == "right", F.col("_new")).when(F.col("side") == "left", F.col("_old")).otherwise(
        F.lit(False))
    return flagged.select(*points.columns, state.alias("outcome"),
                          F.when(state == "resolved", within).alias("within"))


def first_interval(entities: DataFrame, hunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Earliest changed line per entity, with the side it is on; entities without hunks are left out."""
    side = F.when(F.col("new_len") > 0, "new").otherwise("old")
    first = hunks.groupBy("path").agg(F.min_by(F.struct(
        F.greatest(F.col("new_start").cast("long"), F.lit(1)).alias("line"), side.alias("side")),
        F.struct(F.greatest(F.col("new_start").cast("long"), F.lit(1)), F.col("new_len") == 0)).alias("_f"))
    return entities.join(first, "path").select(id_col, "path", "_f.line", "_f.side")


def change_size(entities: DataFrame, hunks: DataFrame, id_col: str = "id", added: str = "added_len",
                removed: str = "removed_len") -> DataFrame:
    """Added and removed line totals per entity, 0/0 where its path has no hunk."""
    totals = hunks.groupBy("path").agg(F.sum(F.col(added).cast("long")).alias("lines_added"),
                                       F.sum(F.col(removed).cast("long")).alias("lines_removed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return entities.join(totals, "path", "left").select(id_col, zero("lines_added"), zero("lines_removed"))
