"""Roll-ups over catalog tables: counts, inventories, column context, direct consumers.

Lists that can grow without bound stay rows: one per member, never an array per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def resource_filter(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def test_counts(models: DataFrame, data_tests: DataFrame, unit_tests: DataFrame) -> DataFrame:
    """Data tests and unit tests per table, zero where there are none."""
    count = lambda df, name: df.filter("table IS NOT NULL").groupBy("table").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return models.select("table").join(count(data_tests, "data_tests"), "table", "left").join(
        count(unit_tests, "unit_tests"), "table", "left").select("table", zero("data_tests"), zero("unit_tests"))


test_counts.__test__ = False


def reference_inventory(variables: DataFrame, refs: DataFrame) -> DataFrame:
    """Per variable the number of models that name it, per tier, and the models whose calls could mean it.

    variables (name, package or NULL); refs (id, package, tier, name, dynamic).
    """
    wanted = variables.select("name", F.col("package").alias("_scope"))
    in_scope = F.col("_scope").isNull() | (F.col("_scope") == F.col("package"))
    named = refs.filter(~F.col("dynamic")).join(wanted, "name").filter(in_scope)
    tiers = named.groupBy("name", "_scope").agg(
        *[F.count_distinct(F.when(F.col("tier") == t, F.col("id"))).alias(t) for t in ("direct", "config", "macro")],
        F.count_distinct("id").alias("models"))
    # a model with an open call may mean any variable it does not also name
    opened = refs.filter("dynamic").select("id", "package").distinct()
    per_scope = opened.groupBy("package").agg(F.count_distinct("id").alias("_open"))
    everywhere = opened.agg(F.count_distinct("id").alias("n")).scalar()
    both = named.join(opened.select("id"), "id", "left_semi").groupBy("name", "_scope").agg(
        F.count_distinct("id").alias("_both"))
    joined = wanted.distinct().join(per_scope, F.col("_scope") == F.col("package"), "left").drop("package")
    null_safe = lambda df, tag: df.select(F.col("name").alias(f"_n{tag}"), F.col("_scope").alias(f"_s{tag}"), *[
        c for c in df.columns if c not in ("name", "_scope")])
    for tag, df in (("t", tiers), ("b", both)):
        right = null_safe(df, tag)
        joined = joined.join(right, (F.col("name") == F.col(f"_n{tag}")) & F.col("_scope").eqNullSafe(F.col(f"_s{tag}")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    reach = F.when(F.col("_scope").isNull(), everywhere).otherwise(zero("_open"))
    return joined.select("name", F.col("_scope").alias("package"), *[zero(t).alias(t) for t in (
        "direct", "config", "macro", "models")], (reach - zero("_both")).alias("dynamic"))


def column_context(columns: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per (table, column, test): type, description, whether documented; tested but undocumented columns stay.

    columns (table, column, data_type, description); tests (table, column, kind, test). Columns without tests have
    one row with NULL test.
    """
    documented = columns.select("table", "column", "data_type", "description", F.lit(True).alias("_doc"))
    attached = tests.filter("column IS NOT NULL").select("table", "column", F.col("kind").alias("test_kind"), "test")
    return documented.join(attached, ["table", "column"], "full").select(
        "table", "column", "data_type", "description", F.coalesce("_doc", F.lit(False)).alias("documented"),
        "test_kind", "test")


def direct_consumers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, consumer), distinct: the nodes one hop downstream of each seed."""
    return edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(
        F.col("src").alias("seed"), F.col("dst").alias("consumer")).distinct()


def macro_index(uses: DataFrame) -> DataFrame:
    """(macro, id), distinct: the nodes that reference each macro."""
    return uses.select("macro", "id").distinct()


def dq_summary(entities: Mapping[str, DataFrame], valid: str, rules: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Per entity: quarantined and total rows, the rate in percent, and failures per rule.

    ``rules`` gives per output name the flag column of each entity; an entity without that rule reports NULL.
    """
    parts = []
    for entity, df in entities.items():
        bad = F.count_if(~F.coalesce(F.col(valid), F.lit(False)))
        counted = df.agg(bad.alias("quarantined_count"), F.count(F.lit(1)).alias("total_count"), *[
            (F.count_if(~F.col(flags[entity])) if entity in flags else F.lit(None).cast("long")).alias(name)
            for name, flags in rules.items()])
        rate = F.when(F.col("total_count") > 0, F.round(F.col("quarantined_count") * 100.0 / F.col("total_count"), 2)
                      ).otherwise(F.lit(0.0))
        parts.append(counted.select(F.lit(entity).alias("entity_type"), "quarantined_count", "total_count",
                                    rate.alias("quarantine_rate_pct"), *rules))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pivot_sum(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], amount: Column | str,
              suffix: str = "_amount", total: str = "total_amount") -> DataFrame:
    """One sum per listed value, and the total over all of them and any other."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(column) == v, amount).otherwise(F.lit(0))).alias(f"{v}{suffix}")
                                 for v in values], F.sum(amount).alias(total))
