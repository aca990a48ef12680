"""Exact dedup: group by a 128-bit content hash, verify the bytes inside groups, keep one row per text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

SALTS = 16


def hash128(text: Column) -> Column:
    """The first 128 bits of the SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _collided(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes shared by different texts: the smallest and the largest text of each repeated hash are compared in full.

    Salting keeps the two texts that every task sends for a hot hash from meeting in one place at once.
    """
    salted = docs.join(repeated, "_key", "left_semi").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["_key", "_salt"], ["_key"]):
        low, high = ("_text", "_text") if "_salt" in keys else ("_low", "_high")
        salted = salted.groupBy(*keys).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    return salted.filter("_low <> _high").select("_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                key: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; a NULL text counts as empty. ``keep`` ("smallest" or "largest") says which id
    of a group stays; a NULL id loses to any other and stays only where the group has no other. Rows that repeat id and
    text are copies of each other of which all carry the kept id, so the first such row stays and ``kept`` is true for
    exactly one row of each group. An empty table gives an empty result; other columns are not looked at.

    Only hashes and ids are shuffled, but for texts whose hash occurs more than once. Joins read written tables on both
    sides, so that adaptive execution can split a hot hash or broadcast a side that is small.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_key", key(F.col("_text")))
    light = cut(texts.select("_id", "_key", F.unhex(F.sha2("_text", 256)).alias("_sha")), "hashes")
    counts = light.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    repeated = cut(counts.filter("_n > 1").select("_key"), "repeated")
    collided = cut(_collided(texts.select("_key", "_text"), repeated), "collided")
    if not collided.isEmpty():  # told apart by their full digest, and by the text itself
        light = cut(texts.join(collided.withColumn("_hit", F.lit(True)), "_key", "left").select(
            "_id", "_key", F.unhex(F.sha2("_text", 256)).alias("_sha"),
            F.when(F.col("_hit"), F.col("_text")).otherwise("").alias("_exact")), "hashes")
    else:
        light = light.withColumn("_exact", F.lit(""))
    rows = light.groupBy("_id", "_key", "_sha", "_exact").agg(F.count(F.lit(1)).alias("_copies"))
    rows = cut(rows, "rows")
    groups = cut(rows.groupBy("_key", "_exact").agg(
        best("_id").alias("keep_id"), F.sum("_copies").alias("group_size")), "groups")
    found = rows.join(groups.withColumnsRenamed({"_key": "_k", "_exact": "_e"}),
                      (F.col("_key") == F.col("_k")) & (F.col("_exact") == F.col("_e")))
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return found.select("*", copy.alias("_copy")).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (stays & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
