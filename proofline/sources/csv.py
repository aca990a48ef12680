"""Seed files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut


def _odd_quotes(line: Column | str) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    return F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record``, ``header``: the records of CSV files, with the line breaks inside quoted fields.

    Files are read by byte ranges. A line begins a record where the quotes before it are even in number: the sum over the ranges
    before its own, one row each, and over the lines before it in its range. Only the lines of records that go over several lines are
    brought together, wherever their ranges lie. A quote that is never closed takes the rest of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("odd", _odd_quotes("value"))
    ranges = lines.groupBy("file", "block").agg(F.sum("odd").alias("quotes"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("quotes"))
    inside = W.partitionBy("file", "block").orderBy("id")
    above = F.coalesce(F.sum("odd").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(ranges, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select(
        "file", "block", "id", "value", "odd", (F.pmod(above + F.col("quotes"), F.lit(2)) == 1).alias("quoted"),
        ((F.col("block") == 0) & (F.row_number().over(inside) == 1)).alias("top"))
    placed = placed.withColumn("begin", F.last(F.when(~F.col("quoted"), F.struct("block", "id", "top")), True).over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    placed = cut(placed, "lines")
    # what a range begins with may belong to the last record begun in a range before it
    last = placed.groupBy("file", "block").agg(F.max("begin").alias("begin"))
    last = last.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.last("begin", True).over(earlier).alias("carried"))
    whole = ~F.col("quoted") & (F.col("odd") == 0)
    clean = lambda text: F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\r\z", "")
    single = placed.filter(whole).select("file", clean(F.col("value")).alias("record"), F.col("top").alias("header"))
    parts = placed.filter(~whole).join(last, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    parts = parts.withColumn("begin", F.coalesce("begin", "carried"))
    joined = parts.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "id", "value"))).alias("lines"))
    several = joined.select("file", clean(F.array_join(F.transform("lines", lambda l: l["value"]), "\n")).alias("record"), F.col("begin.top").alias("header"))
    return single.unionByName(several)


def read_seed_csv(spark: SparkSession, path: str, delimiter: str = ",", column_types: Mapping[str, str] = {}) -> DataFrame:
    """Header-keyed RFC 4180 text: quoted fields, embedded newlines, short rows padded with NULL, extras dropped.

    All columns are text unless typed; an empty field is NULL. Every file begins with the header. A file of any size is read by many tasks.
    """
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(header=True, multiLine=True, inferSchema=False, **options).csv(path).columns
    quoted = [name.replace("`", "``") for name in names]
    shape = ", ".join(f"`{name}` string" for name in quoted)
    rows = csv_records(spark, path).filter(~F.col("header") & (F.col("record") != ""))
    rows = rows.select(F.from_csv("record", shape, options).alias("_r"))
    return rows.select(*[F.col(f"_r.`{q}`").cast(column_types.get(name, "string")).alias(name) for name, q in zip(names, quoted)])
