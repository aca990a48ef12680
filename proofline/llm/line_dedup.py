"""Line dedup: range-partitioned line hashes with a secondary sort by document and position, and keep bitmaps.

The bitmaps of a document are runs of dropped line positions; texts are rebuilt only where a caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "array<struct<start:int,length:int>>"


def line_key(line: Column) -> Column:
    """A line without the ASCII white space around it, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.sha2(text, 256).alias("_sha"))


def _runs(positions: Column) -> Column:
    """Sorted positions as runs of neighbours."""
    def add(runs, p):
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1),
                          F.array(F.struct(last["start"].alias("start"), (last["length"] + 1).alias("length"))))
        fresh = F.concat(runs, F.array(F.struct(p.alias("start"), F.lit(1).alias("length"))))
        grows = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["start"] + F.try_element_at(runs, F.lit(-1))["length"] == p)
        return F.when(grows, longer).otherwise(fresh)
    return F.aggregate(positions, F.array().cast(RUNS), add)


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1,
                 keep: str = "first") -> DataFrame:
    """``_id``, ``_sha``, ``runs``: the dropped lines of every row that loses any, as runs of positions from 0.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` rows loses its lines: all of them with
    ``keep="none"``, all but its first (by id, text digest and position) with ``keep="first"``. A NULL text is empty.
    Rows that repeat id and text count as documents of their own and share one bitmap.
    """
    lines = _rows(docs, id_col, text_col).select("_id", "_sha", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_k", line_key(F.col("_line"))).filter(F.length("_k") >= min_chars)
    hashed = lines.select(F.xxhash64("_k").alias("_h1"), F.xxhash64(F.lit(1), "_k").alias("_h2"), "_id", F.unhex("_sha").alias("_sha"), "_pos")
    order = ("_h1", "_h2", "_id", "_sha", "_pos")
    lines = cut(hashed.repartitionByRange(*order).sortWithinPartitions(*order), "lines")

    often = lines.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs).drop("_n")
    seen = lines.join(cut(often, "often"), ["_h1", "_h2"], "left_semi")
    # one row per key and document; a repeated row shows as a position that occurs more than once
    held = seen.groupBy("_h1", "_h2", "_id", "_sha", "_pos").agg(F.count(F.lit(1)).alias("_copies"))
    held = held.groupBy("_h1", "_h2", "_id", "_sha").agg(
        F.max("_copies").alias("_copies"), F.collect_list("_pos").alias("_at"), F.min("_pos").alias("_first"))
    held = cut(held, "held")
    shared = held.groupBy("_h1", "_h2").agg(
        F.sum("_copies").alias("_docs"), F.min(F.struct("_id", "_sha", "_first")).alias("_one"))
    shared = cut(shared.filter(F.col("_docs") >= min_docs).drop("_docs"), "shared")
    gone = held.join(shared, ["_h1", "_h2"])
    if keep == "first":
        one = F.col("_id").eqNullSafe(F.col("_one")["_id"]) & (F.col("_sha") == F.col("_one")["_sha"])
        at = F.when(one, F.filter("_at", lambda p: p != F.col("_one")["_first"])).otherwise(F.col("_at"))
        gone = gone.withColumn("_at", at)
    rows = gone.groupBy("_id", "_sha").agg(F.flatten(F.collect_list("_at")).alias("_at"))
    return rows.filter(F.size("_at") > 0).select("_id", F.lower(F.hex("_sha")).alias("_sha"), _runs(F.array_sort("_at")).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1,
               keep: str = "first") -> DataFrame:
    """One row per input row: ``id_col``, ``n_lines``, ``n_dropped``, ``dropped`` (runs of positions), ``kept_text``.

    A NULL or empty text is one empty line. NULL ids are documents like any other. An empty table gives an empty result.
    """
    marks = cut(drop_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep), "bitmaps")
    rows = _rows(docs, id_col, text_col)
    marks = marks.withColumnsRenamed({"_id": "_mid", "_sha": "_msha"})
    both = rows.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_sha") == F.col("_msha")), "left")
    positions = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    # a map lookup per line, so that a text of very many lines stays linear
    lost = F.map_from_arrays(positions, F.transform(positions, lambda p: F.lit(True)))
    kept = F.filter(F.split("_text", "\n"), lambda line, i: F.try_element_at(lost, i).isNull())
    return both.select(
        F.col("_id").alias(id_col), F.size(F.split("_text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["length"]), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("runs", F.array().cast(RUNS)).alias("dropped"),
        F.when(F.col("runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
