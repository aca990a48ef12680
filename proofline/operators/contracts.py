"""Contract changes between two versions: unchanged, changed but safe, or breaking, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import same_type
from .numbering import same

ENFORCING = ("table", "incremental")

# What each platform does with a declared constraint of each kind.
SUPPORT = {
    "postgres": {"enforced": ("not_null", "foreign_key"), "not_enforced": ("unique", "primary_key")},
    "duckdb": {"enforced": ("not_null", "foreign_key"), "not_enforced": ("unique", "primary_key")},
    "snowflake": {"enforced": ("not_null", "foreign_key"), "not_enforced": ("unique", "primary_key")},
    "bigquery": {"enforced": ("not_null",), "not_enforced": ("primary_key", "foreign_key")},
    "databricks": {"enforced": ("not_null", "check"), "not_enforced": ("primary_key", "foreign_key")},
    "redshift": {"enforced": ("not_null",), "not_enforced": ("unique", "primary_key", "foreign_key")},
}


def constraint_support(platform: str, kind: str) -> str:
    """enforced, not_enforced or not_supported; an unknown platform enforces nothing."""
    rules = SUPPORT.get(platform.lower())
    if rules is None:
        return "not_enforced"
    return next((level for level, kinds in rules.items() if kind in kinds), "not_supported")


def support_column(platform, kind):
    """The same rule over columns, for catalogs of many platforms."""
    out = F.lit("not_enforced")
    for name, rules in SUPPORT.items():
        per_kind = F.lit("not_supported")
        for level, kinds in rules.items():
            per_kind = F.when(kind.isin(*kinds), level).otherwise(per_kind)
        out = F.when(F.lower(platform) == name, per_kind).otherwise(out)
    return out


def contract_reasons(old_nodes: DataFrame, new_nodes: DataFrame, old_columns: DataFrame, new_columns: DataFrame,
                     old_constraints: DataFrame, new_constraints: DataFrame) -> DataFrame:
    """One row (id, reason, detail) per breaking change; nodes with a decided outcome have at most one.

    nodes (id, enforced, checksum, materialized); columns (id, name, type); constraints (id, column, kind, expression)
    with a NULL column for the table's own constraints.
    """
    pair = _pairs(old_nodes, new_nodes)
    none = F.lit(None).cast("string")
    was = old_columns.select("id", "name", F.col("type").alias("_old"))
    now = new_columns.select("id", "name", F.col("type").alias("_new"), F.lit(True).alias("_here"))
    retyped = F.concat(F.col("name"), F.lit(": "), F.coalesce("_old", F.lit("unknown")), F.lit(" -> "),
                       F.coalesce("_new", F.lit("unknown")))
    columns = was.join(now, ["id", "name"], "left").select("id", F.when(
        F.col("_here").isNull(), F.struct(F.lit("column_removed").alias("reason"), F.col("name").alias("detail"))).when(
        ~same_type(F.col("_old"), F.col("_new")),
        F.struct(F.lit("column_type_changed").alias("reason"), retyped.alias("detail"))).alias("r")).select(
        "id", "r.reason", "r.detail")
    structural = old_constraints.filter("column IS NULL OR kind <> 'custom'")
    there = new_constraints.select(*[F.col(c).alias(f"_{c}") for c in ("id", "column", "kind", "expression")]).distinct()
    lost = structural.join(there, (F.col("id") == F.col("_id")) & same(F.col("column"), F.col("_column")) & same(
        F.col("kind"), F.col("_kind")) & same(F.col("expression"), F.col("_expression")), "left_anti")
    level = F.when(F.col("column").isNull(), "model_constraint_removed").otherwise("column_constraint_removed")
    constraints = lost.select("id", level.alias("reason")).distinct().select("id", "reason", none.alias("detail"))
    had = structural.select("id").distinct().select("id", F.lit("materialization_changed").alias("reason"), none.alias("detail"))
    found = columns.filter("reason IS NOT NULL").unionByName(constraints).unionByName(had)
    # each reason counts only where the pair of nodes lets it
    counts = (F.when(F.col("reason").startswith("column_") & ~F.col("reason").contains("constraint"), F.lit(True))
              .when(F.col("reason") == "materialization_changed", F.col("old_enforces") & ~F.col("new_enforces"))
              .otherwise(F.col("old_enforces")))
    kept = found.join(pair.filter("open"), "id").filter(counts).select("id", "reason", "detail")
    dropped = pair.filter("old_enforced AND NOT new_enforced").select(
        "id", F.lit("contract_enforcement_dropped").alias("reason"), none.alias("detail"))
    return dropped.unionByName(kept)


def _pairs(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    strict = lambda c: F.coalesce(F.col(c).isin(*ENFORCING), F.lit(False))
    was = old_nodes.select("id", flag("enforced").alias("old_enforced"), F.col("checksum").alias("_oc"),
                           strict("materialized").alias("old_enforces"))
    now = new_nodes.select("id", flag("enforced").alias("new_enforced"), F.col("checksum").alias("_nc"),
                           strict("materialized").alias("new_enforces"))
    both = was.join(now, "id")
    equal = F.coalesce(F.col("_oc") == F.col("_nc"), F.lit(False))
    return both.withColumn("open", F.col("old_enforced") & F.col("new_enforced") & ~equal)


def classify_contract(old_nodes: DataFrame, new_nodes: DataFrame, old_columns: DataFrame, new_columns: DataFrame,
                      old_constraints: DataFrame, new_constraints: DataFrame) -> DataFrame:
    """(id, change, n_reasons) with change unchanged, changed_not_breaking or breaking."""
    reasons = contract_reasons(old_nodes, new_nodes, old_columns, new_columns, old_constraints, new_constraints)
    per_node = reasons.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = _pairs(old_nodes, new_nodes).join(per_node, "id", "left")
    change = F.when(F.col("_n") > 0, "breaking").when(
        ~F.col("old_enforced") & F.col("new_enforced"), "changed_not_breaking").otherwise("unchanged")
    return joined.select("id", change.alias("change"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_reasons"))


def schema_rows(df: DataFrame, table: str) -> DataFrame:
    rows = [(table, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "id string, name string, type string")


def diff_schemas(old: DataFrame, new: DataFrame, table: str = "table") -> DataFrame:
    """Column changes between two live tables: added columns are safe, removed and retyped ones break."""
    was = schema_rows(old, table).select("id", "name", F.col("type").alias("old_type"))
    now = schema_rows(new, table).select("id", "name", F.col("type").alias("new_type"))
    both = was.join(now, ["id", "name"], "full")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(~same_type(F.col("old_type"), F.col("new_type")), "type_changed").otherwise("unchanged"))
    return both.select("id", "name", "old_type", "new_type", change.alias("change"),
                       change.isin("removed", "type_changed").alias("breaking"))


def value_counts(df: DataFrame) -> DataFrame:
    """(name, n_values): non-NULL values per column, in one pass."""
    names = df.columns
    counted = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_n{i}").alias("n_values")) for i, c in enumerate(names)])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def schema_impact(old: DataFrame, new: DataFrame, table: str = "table") -> DataFrame:
    """Column changes with the number of stored values each of them affects."""
    return diff_schemas(old, new, table).join(value_counts(old), "name", "left").select(
        "id", "name", "old_type", "new_type", "change", "breaking", F.coalesce("n_values", F.lit(0).cast("long")).alias(
            "affected_values"))
