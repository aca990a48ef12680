"""Literal test tables: dict rows, CSV text or SQL."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import KEY_TYPE, absent_key, cell_key, csv_key, plain_double, typed_key


class NotTabularError(ValueError):
    """Text was given where rows were expected."""


def variant_key(row: Column, name: str) -> Column:
    """Key of one entry of a ``map<string, variant>`` row: absent, null, bool, number, string or compact JSON."""
    value = row[name]
    kind = F.schema_of_variant(value)
    text = F.variant_get(value, "$", "string")
    number = F.when(kind.startswith("BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), text).otherwise(
        plain_double(F.try_variant_get(value, "$", "double")))
    return (
        F.when(~F.map_contains_key(row, F.lit(name)), absent_key())
        .when(value.isNull() | F.is_variant_null(value), cell_key("null"))
        .when(kind == "BOOLEAN", cell_key("bool", text))
        .when(kind == "STRING", cell_key("str", text))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), cell_key("number", number))
        .otherwise(cell_key("str", F.to_json(value)))
    )


def sparse_rows(df: DataFrame, column: str) -> DataFrame:
    """JSON object text to ``map<string, variant>``; a missing entry stays apart from a null one."""
    return df.withColumn(column, F.from_json(column, "map<string,variant>"))


def column_names(rows: Sequence[Mapping]) -> list[str]:
    """Union of the rows' names in first-seen order."""
    return list(dict.fromkeys(name for row in rows for name in row))


def fixture_table(spark: SparkSession, rows, fmt: str = "dict") -> DataFrame:
    """A table from a test file: ``ordinal`` plus one struct (display, key) per column.

    ``rows`` is a list of dicts, CSV text or SQL text according to ``fmt``. SQL rows have no authored order: their ordinal
    only tells them apart.
    """
    if fmt == "sql":
        typed = spark.sql(rows)
        cells = [F.struct(F.col(f"`{f.name}`").cast("string").alias("display"), typed_key(F.col(f"`{f.name}`"), f.dataType).alias("key")).alias(f.name)
                 for f in typed.schema.fields]
        return typed.select(F.monotonically_increasing_id().alias("ordinal"), *cells)
    if rows is None or len(rows) == 0:
        return spark.createDataFrame([], "ordinal long")
    if fmt == "csv":
        if not isinstance(rows, str):
            names = column_names(rows)
            return _csv_cells(spark, names, [["" if r.get(c) is None else str(r[c]) for c in names] for r in rows])
        return csv_text_table(spark, rows)
    if isinstance(rows, str):
        raise NotTabularError("text under the dict format is not a table")
    names = column_names(rows)
    lines = [(i, json.dumps(row, default=str)) for i, row in enumerate(rows)]
    sparse = sparse_rows(spark.createDataFrame(lines, "ordinal long, row string"), "row")
    cells = [F.struct(
        F.when(F.map_contains_key("row", F.lit(n)) & ~F.is_variant_null(F.col("row")[n]),
               F.to_json(F.col("row")[n])).alias("display"), variant_key(F.col("row"), n).alias("key")).alias(n)
        for n in names]
    return sparse.select("ordinal", *cells)


def csv_text_table(spark: SparkSession, text: str) -> DataFrame:
    """CSV text of a fixture, kept in authored order; a header alone is an empty table. A byte order mark and blank lines at the
    end are not part of it."""
    import csv
    import io
    lines = list(csv.reader(io.StringIO(text.removeprefix("\ufeff").rstrip("\r\n"))))
    if len(lines) < 2:
        return spark.createDataFrame([], "ordinal long")
    return _csv_cells(spark, lines[0], lines[1:])


def _csv_cells(spark: SparkSession, header: Sequence[str], lines: Sequence[list[str]]) -> DataFrame:
    padded = [(i, (line + [""] * len(header))[:len(header)]) for i, line in enumerate(lines)]
    raw = spark.createDataFrame(padded, "ordinal long, fields array<string>")
    return raw.select("ordinal", *[F.struct(F.col("fields")[i].alias("display"), csv_key(F.col("fields")[i]).alias(
        "key")).alias(name) for i, name in enumerate(header)])


__all__ = ["KEY_TYPE", "NotTabularError", "column_names", "csv_text_table", "fixture_table", "sparse_rows", "variant_key"]
