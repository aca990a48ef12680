"""Governance rules over catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import deprecation_state
from .numbering import same


def governance_audit(scope: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, contracts: DataFrame,
                     as_of: Column) -> DataFrame:
    """(id, rule, detail, severity) for every rule an in-scope model trips.

    nodes (id, kind, access, group, version, latest_version, deprecation_date); edges (src, dst); groups (group,
    owner_email); contracts (id, change). Unset access counts as protected.
    """
    models = nodes.join(scope.select("id").distinct(), "id", "left_semi")
    none = F.lit(None).cast("string")
    chip = lambda df, rule, detail, severity=none: df.select(
        "id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"), severity.alias("severity"))
    broken = models.filter("access = 'public'").join(
        contracts.filter("change = 'breaking'").select("id").distinct(), "id", "left_semi")
    lagging = models.filter("version <> latest_version")
    owned = models.filter("group IS NOT NULL").join(groups.filter("owner_email IS NOT NULL"), "group")
    target = nodes.filter("kind = 'model'").select(
        F.col("id").alias("target"), F.coalesce("access", F.lit("protected")).alias("_access"),
        F.col("group").alias("_group"), deprecation_state(F.col("deprecation_date"), as_of).alias("_dep"))
    refs = edges.select(F.col("dst").alias("id"), F.col("src").alias("target")).distinct().join(
        models.select("id", "group"), "id").join(target, "target")
    deprecated = refs.filter("_dep IS NOT NULL")
    private = refs.filter((F.col("_access") == "private") & ~same(F.col("group"), F.col("_group")))
    return (
        chip(broken, "public_contract_broken", none)
        .unionByName(chip(lagging, "version_lags_latest", F.concat_ws(" / ", "version", "latest_version")))
        .unionByName(chip(owned, "group_owner_touch", F.concat_ws(" / ", "group", "owner_email")))
        .unionByName(chip(deprecated, "ref_to_deprecated", F.col("target"), F.col("_dep.severity")))
        .unionByName(chip(private, "access_violation", F.col("target")))
    )
