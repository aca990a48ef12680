"""Named SQL functions, so that the value keys can be used from ``spark.sql``; they inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .keys import BLANKS, INTEGER, NUMBER, PLAIN
from .scalars import CALL, QUOTES, RELATION, TYPE_FAMILIES


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _definitions() -> dict[str, tuple[str, str, str]]:
    families = " ".join(
        f"WHEN t IN ({', '.join(_text(s) for s in spellings)}) THEN {_text(family)}"
        for family, spellings in TYPE_FAMILIES.items()
    )
    whole = r"regexp_replace(regexp_replace(x, '^\\+', ''), '^(-?)0+([0-9])', '$1$2')"
    decimal = (
        "CASE WHEN abs(try_cast(x AS double)) < double('Infinity') THEN "
        f"format_number(try_cast(x AS double) + 0.0D, '{PLAIN}') END"
    )
    return {
        "pl_number": (
            "x STRING", "STRING",
            f"CASE WHEN x RLIKE {_text(INTEGER)} THEN CASE WHEN {whole} = '-0' THEN '0' ELSE {whole} END"
            f" WHEN x RLIKE {_text(NUMBER)} THEN {decimal} END"),
        "pl_whole": ("x STRING", "STRING", r"CASE WHEN contains(x, '.') THEN regexp_replace(x, '\\.?0+$', '') ELSE x END"),
        "pl_relation_part": (
            "x STRING, i INT", "STRING",
            f"lower(regexp_replace(trim(try_element_at(regexp_extract_all(x, {_text(RELATION)}, 1), i)), {_text(QUOTES)}, ''))"),
        "pl_csv_token": (
            "x STRING", "STRING",
            "CASE WHEN x IS NULL OR x = '' THEN 'null' WHEN pl_number(x) IS NOT NULL"
            " THEN concat('number:', pl_number(x)) WHEN lower(x) IN ('true', 'false')"
            " THEN concat('bool:', lower(x)) ELSE concat('str:', x) END"),
        "pl_trimmed": ("x STRING", "STRING", f"regexp_replace(x, {_text(BLANKS)}, '')"),
        "pl_token": (
            "x STRING", "STRING",
            "CASE WHEN x IS NULL OR pl_trimmed(x) IN ('', 'null', '~') THEN 'null'"
            " WHEN length(pl_trimmed(x)) >= 2 AND left(pl_trimmed(x), 1) IN ('\"', '\\'') AND left(pl_trimmed(x), 1) = right(pl_trimmed(x), 1)"
            " THEN concat('str:', substring(pl_trimmed(x), 2, length(pl_trimmed(x)) - 2))"
            " WHEN pl_trimmed(x) IN ('true', 'false') THEN concat('bool:', pl_trimmed(x))"
            " WHEN pl_number(pl_trimmed(x)) IS NOT NULL THEN concat('number:', pl_number(pl_trimmed(x))) ELSE concat('str:', pl_trimmed(x)) END"),
        "pl_path": (
            "x STRING", "STRING",
            r"regexp_replace(regexp_replace(translate(x, '\\', '/'), '^(\\./)+', ''), '/{2,}', '/')"),
        "pl_leaf": ("x STRING", "STRING", "substring_index(x, '.', -1)"),
        "pl_bare_name": (
            "x STRING", "STRING",
            r"CASE WHEN size(split(x, '\\.')) >= 4 AND substring_index(x, '.', -1) RLIKE '^v[0-9]+$'"
            r" THEN try_element_at(split(x, '\\.'), -2) ELSE substring_index(x, '.', -1) END"),
        "pl_type": (
            "x STRING", "STRING",
            f"(SELECT CASE {families} ELSE t END FROM (SELECT lower(trim(substring_index(x, '(', 1))) AS t))"),
        "pl_typed": (  # of any column, cast to VARIANT
            "x VARIANT", "STRING",
            "CASE WHEN x IS NULL OR is_variant_null(x) THEN 'null' WHEN schema_of_variant(x) = 'BOOLEAN' THEN concat('bool:', try_variant_get(x, '$', 'string'))"
            " WHEN schema_of_variant(x) IN ('TINYINT', 'SMALLINT', 'INT', 'BIGINT') OR schema_of_variant(x) LIKE 'DECIMAL%'"
            " THEN concat('number:', pl_whole(try_variant_get(x, '$', 'string')))"
            f" WHEN schema_of_variant(x) IN ('FLOAT', 'DOUBLE') AND abs(try_variant_get(x, '$', 'double')) < double('Infinity')"
            f" THEN concat('number:', format_number(try_variant_get(x, '$', 'double') + 0.0D, '{PLAIN}'))"
            " ELSE concat('str:', try_variant_get(x, '$', 'string')) END"),
        "pl_row_key": (
            "x ARRAY<STRING>", "STRING", "array_join(transform(x, t -> concat(octet_length(t), ':', t)), '')"),
        "pl_relation": (
            "x STRING", "STRUCT<database STRING, schema STRING, identifier STRING>",
            "named_struct('database', pl_relation_part(x, -3), 'schema', pl_relation_part(x, -2), 'identifier', pl_relation_part(x, -1))"),
        "pl_input_leaf": (
            "x STRING", "STRING",
            f"lower(nullif(concat(regexp_extract(x, {_text(CALL)}, 1), regexp_extract(x, {_text(CALL)}, 2)), ''))"),
        "pl_surrogate_key": (
            "x ARRAY<STRING>", "STRING", "md5(array_join(transform(x, c -> coalesce(c, '_null_')), '-'))"),
        "pl_bucket": (  # the label of the first edge above x
            "x DOUBLE, edges ARRAY<DOUBLE>, labels ARRAY<STRING>, last STRING", "STRING",
            "coalesce(try_element_at(filter(transform(edges, (e, i) -> CASE WHEN x < e THEN labels[i] END), l -> l IS NOT NULL), 1), last)"),
        "pl_mask": ("x STRING, allowed BOOLEAN", "STRING", "CASE WHEN allowed THEN x ELSE '***' END"),
        "pl_hash_pii": ("x STRING", "STRING", "md5(x)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for name, (arguments, returns, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
        names.append(name)
    return names
