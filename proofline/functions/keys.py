"""Canonical value keys: two cells are equal when their keys are, however they were written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

INTEGER = r"^[+-]?[0-9]+\z"  # \z, as $ also matches before a final line end
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
BLANKS = r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z"

PLAIN = "0." + "#" * 340

KEY_TYPE = T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])


def cell_key(tag: str, value: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(tag).alias("t"), value.cast("string").alias("v"))


def absent_key() -> Column:
    """The key of a cell whose column the table does not have; distinct from NULL."""
    return cell_key("absent")


def _strip_fraction_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def plain_double(value: Column) -> Column:
    """A double as plain decimal text: no exponent, no trailing zeros, no negative zero."""
    return F.call_function("format_number", value + F.lit(0.0), F.lit(PLAIN))


def canonical_number(text: Column) -> Column:
    """Numeric text in canonical form, NULL when it is not a finite number; integers stay exact at any width."""
    whole = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+([0-9])", "$1$2")
    whole = F.when(whole == "-0", F.lit("0")).otherwise(whole)
    as_double = F.when(text.rlike(NUMBER), text).try_cast("double")
    finite = as_double.isNotNull() & (F.abs(as_double) < F.lit(float("inf")))
    return F.when(text.rlike(INTEGER), whole).when(finite, plain_double(as_double))


def csv_key(text: Column) -> Column:
    """Key of a CSV field: empty is NULL, then number, then boolean in any case, else the text as it stands."""
    number = canonical_number(text)
    lowered = F.lower(text)
    return (
        F.when(text.isNull() | (text == ""), cell_key("null"))
        .when(number.isNotNull(), cell_key("number", number))
        .when(lowered.isin("true", "false"), cell_key("bool", lowered))
        .otherwise(cell_key("str", text))
    )


def token_key(text: Column) -> Column:
    """Key of a scalar token: quotes keep a string, ``null`` and ``~`` are NULL, booleans are lower-case only."""
    token = F.regexp_replace(text, BLANKS, "")
    quoted = token.rlike(r"""^"(?s:.*)"\z|^'(?s:.*)'\z""") & (F.length(token) >= 2)
    inner = token.substr(F.lit(2), F.length(token) - 2)
    number = canonical_number(token)
    return (
        F.when(text.isNull(), cell_key("null"))
        .when(quoted, cell_key("str", inner))
        .when(token.isin("", "null", "~"), cell_key("null"))
        .when(token.isin("true", "false"), cell_key("bool", token))
        .when(number.isNotNull(), cell_key("number", number))
        .otherwise(cell_key("str", token))
    )


def typed_key(value: Column, dtype: T.DataType) -> Column:
    """Key of an already typed column, chosen from its type when the plan is built."""
    if isinstance(dtype, T.NullType):
        return cell_key("null")
    if isinstance(dtype, T.BooleanType):
        keyed = cell_key("bool", value)
    elif isinstance(dtype, T.IntegralType):
        keyed = cell_key("number", value)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        finite = ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf")))
        keyed = F.when(finite, cell_key("number", plain_double(wide))).otherwise(cell_key("str", value))
    elif isinstance(dtype, T.DecimalType):
        keyed = cell_key("number", _strip_fraction_zeros(value.cast("string")))
    elif isinstance(dtype, T.TimestampNTZType):
        keyed = cell_key("str", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(dtype, T.TimestampType):
        utc = F.to_utc_timestamp(value, F.current_timezone())
        keyed = cell_key("str", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif isinstance(dtype, T.BinaryType):
        keyed = cell_key("str", F.hex(value))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        keyed = cell_key("str", F.to_json(value))
    else:
        keyed = cell_key("str", value)
    return F.when(value.isNull(), cell_key("null")).otherwise(keyed)


def key_token(key: Column) -> Column:
    """``tag:value``, or the bare tag where there is no value."""
    return F.when(key["v"].isNull(), key["t"]).otherwise(F.concat(key["t"], F.lit(":"), key["v"]))


def row_key(keys: Sequence[Column]) -> Column:
    """One text per row; byte lengths before the tokens keep distinct rows distinct."""
    tokens = [key_token(key) for key in keys]
    return F.concat(*[part for t in tokens for part in (F.octet_length(t).cast("string"), F.lit(":"), t)])
