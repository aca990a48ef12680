"""Scalar column functions over paths, names, types, dates and small JSON values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# SQL type spellings that mean the same type.
TYPE_FAMILIES = {
    "string": ("string", "varchar", "text", "char", "character varying"),
    "integer": ("int", "integer", "int4"),
    "bigint": ("bigint", "int8"),
    "boolean": ("bool", "boolean"),
    "double": ("float", "float8", "double", "double precision"),
}


def normalize_path(path: Column, strip: str | None = None) -> Column:
    """Forward slashes, no leading ``./``, optional project root removed, slash runs collapsed."""
    out = F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")
    root = (strip or "").replace("\\", "/").rstrip("/")
    if root:
        tail = out.substr(F.lit(len(root) + 2), F.length(out))
        out = F.when(out == root, F.lit("")).when(out.startswith(root + "/"), tail).otherwise(out)
    return F.regexp_replace(out, "/{2,}", "/")


RELATION, QUOTES = r'("[^"]*"|`[^`]*`|\[[^\]]*\]|[^.]+)', r'^["`\[]|["`\]]$'
CALL = r"""^\s*(?:ref|source)\s*\(\s*(?:(?:'[^']*'|"[^"]*")\s*,\s*)*(?:'([^']*)'|"([^"]*)")\s*\)\s*$"""


def parse_relation(name: Column) -> Column:
    """Quoted dotted name to lower-case (database, schema, identifier), filled from the right."""
    parts = F.regexp_extract_all(name, F.lit(RELATION), 1)
    clean = F.transform(parts, lambda p: F.lower(F.regexp_replace(F.trim(p), QUOTES, "")))
    return F.struct(
        F.try_element_at(clean, F.lit(-3)).alias("database"),
        F.try_element_at(clean, F.lit(-2)).alias("schema"),
        F.try_element_at(clean, F.lit(-1)).alias("identifier"),
    )


def input_leaf(call: Column) -> Column:
    """Last literal of ``ref('a', 'b')`` or ``source("a", "b")`` in lower case, else NULL."""
    leaf = F.concat(F.regexp_extract(call, CALL, 1), F.regexp_extract(call, CALL, 2))
    return F.when(leaf != "", F.lower(leaf))


def is_version_suffix(segment: Column) -> Column:
    return segment.rlike("^v[0-9]+$")


def bare_name(identifier: Column) -> Column:
    """Last dotted segment, or the one before it where an id of four or more segments ends in a version."""
    parts = F.split(identifier, r"\.")
    last = F.element_at(parts, -1)
    versioned = is_version_suffix(last) & (F.size(parts) >= 4)
    return F.when(versioned, F.try_element_at(parts, F.lit(-2))).otherwise(last)


def leaf_name(identifier: Column) -> Column:
    return F.substring_index(identifier, ".", -1)


def canonical_type(declared: Column) -> Column:
    base = F.lower(F.trim(F.substring_index(declared, "(", 1)))
    out = None
    for family, spellings in TYPE_FAMILIES.items():
        out = F.when(base.isin(*spellings), F.lit(family)) if out is None else out.when(
            base.isin(*spellings), F.lit(family))
    return out.otherwise(base)


def same_type(left: Column, right: Column) -> Column:
    both_missing = left.isNull() & right.isNull()
    return both_missing | F.coalesce(canonical_type(left) == canonical_type(right), F.lit(False))


def deprecation_state(raw: Column, as_of: Column) -> Column:
    """(state, severity): ``scheduled``/``info`` after the given day, ``elapsed``/``danger`` on or before it."""
    shape = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$"
    part = lambda i: F.regexp_extract(raw, shape, i).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    valid = month.between(1, 12) & day.between(1, 31)
    code = year * 10000 + month * 100 + day
    today = F.year(as_of) * 10000 + F.month(as_of) * 100 + F.day(as_of)
    late = code > today
    return F.when(
        valid,
        F.struct(
            F.when(late, "scheduled").otherwise("elapsed").alias("state"),
            F.when(late, "info").otherwise("danger").alias("severity"),
        ),
    )


_QUOTED = r"""'[^']*+'|"[^"]*+\""""
_INNER = rf"""\{{(?:{_QUOTED}|[^{{}}'"]++)*+\}}"""
_BRACED = rf"""\{{(?:{_QUOTED}|{_INNER}|[^{{}}'"]++)*+\}}"""
# in the order they are tried: comments, raw blocks, expressions, statements; one left open runs to the end
TEMPLATE_REGION = "(?s)" + "|".join((
    r"\{#.*?(?:#\}|\z)",
    r"\{%-?\s*raw\s*-?%\}.*?(?:\{%-?\s*endraw\s*-?%\}|\z)",
    rf"""\{{\{{(?:{_QUOTED}|{_BRACED}|[^{{}}'"]++)*+\}}\}}""",
    r"\{%.*?(?:%\}|\z)",
    r"\{\{.*\z",
))
SILENT_REGION = r"(?s)^(\{#|\{%-?\s*raw\s*-?%\})"
VAR_CALL = r"""(?<![A-Za-z0-9_.])var(?:\.has_var)?\s*\(\s*(?:'[^']*'|"[^"]*")?"""


def text_references(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, dynamic): names in literal ``var('x')`` calls inside template regions; a call with no literal name is
    dynamic. Comments and raw blocks are no regions."""
    regions = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(TEMPLATE_REGION), 0), lambda r: ~r.rlike(SILENT_REGION))
    calls = F.flatten(F.transform(regions, lambda r: F.regexp_extract_all(r, F.lit(VAR_CALL), 0)))
    literal = F.regexp_extract("call", r"""(?s)['"](.*)['"]$""", 1)
    named = F.col("call").rlike(r"""['"]$""")
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(calls)).alias("call")).select(
        "id", F.when(named, literal).alias("name"), (~named).alias("dynamic")).distinct()


def surrogate_key(columns: Sequence[Column]) -> Column:
    """MD5 over the natural key; a NULL part is marked so that it differs from an empty one."""
    parts = [F.coalesce(c.cast("string"), F.lit("_null_")) for c in columns]
    return F.md5(F.concat_ws("-", *parts))


def mask(value: Column, allowed: Column | bool) -> Column:
    allowed = F.lit(allowed) if isinstance(allowed, bool) else allowed
    return F.when(allowed, value.cast("string")).otherwise(F.lit("***"))


def hash_pii(value: Column) -> Column:
    return F.md5(value.cast("string"))


def bucket(value: Column, edges: Sequence[tuple[float, str]], last: str, inclusive: bool = False) -> Column:
    """Label of the first edge above the value (or at it, when inclusive), else the last label."""
    out = None
    for edge, label in edges:
        below = value <= edge if inclusive else value < edge
        out = F.when(below, F.lit(label)) if out is None else out.when(below, F.lit(label))
    return out.otherwise(F.lit(last))


def guarded_ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def meta_pairs(meta_json: Column) -> Column:
    """A JSON object as entries sorted by name."""
    return F.array_sort(F.map_entries(F.from_json(meta_json, "map<string,string>")))


def sorted_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))
