"""Coverage audits: does the data, or the declared test suite, really exercise what it claims to?

Verdicts are ``covered``, ``uncovered`` and ``unknown``; what the given tables cannot decide is unknown, never
uncovered. Findings have the columns (check, table, construct, verdict, tier, evidence).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .contracts import support_column
from .joins import covers, match_keys
from .numbering import all_of, number_rows

FINDING = ["check", "table", "construct", "verdict", "tier", "evidence"]

# Test spellings that claim uniqueness, with the package they must come from.
UNIQUENESS_TESTS = {
    "unique": None,
    "expect_column_values_to_be_unique": "dbt_expectations",
    "unique_combination_of_columns": "dbt_utils",
    "primary_key": "dbt_constraints",
    "unique_key": "dbt_constraints",
    "expect_compound_columns_to_be_unique": "dbt_expectations",
}
BACKING_TESTS = ("unique", "unique_combination_of_columns")


def finding(df: DataFrame, check: str, table: Column, construct: Column, verdict: Column, tier: str,
            evidence: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), table.cast("string").alias("table"), construct.cast("string").alias(
        "construct"), verdict.alias("verdict"), F.lit(tier).alias("tier"), evidence.cast("string").alias("evidence"))


def audit_union_arms(arms: Mapping[str, Sequence[str]], tables: Mapping[str, DataFrame | None],
                     table: str = "model", union: str = "union") -> DataFrame:
    """One finding per union; an arm is fed when any of its inputs has a row, an input given as None is unknown.

    Nothing runs before the result is asked for. Each input then offers its first row and no more.
    """
    spark = next(df for df in tables.values() if df is not None).sparkSession
    listed = spark.createDataFrame([(arm, t) for arm, inputs in arms.items() for t in inputs], "arm string, input string")
    present = None
    for t in sorted({t for inputs in arms.values() for t in inputs}):
        if tables.get(t) is not None:
            row = tables[t].select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("present")).select(F.lit(t).alias("input"), "present")
            present = row if present is None else present.unionByName(row)
    every = spark.createDataFrame([(arm,) for arm in arms], "arm string")
    told = listed if present is None else listed.join(present, "input", "left")
    told = told if present is not None else told.withColumn("present", F.lit(None).cast("boolean"))
    per_arm = every.join(told.groupBy("arm").agg(F.max("present").alias("fed"), F.bool_or(F.col("present").isNull()).alias("open")), "arm", "left")
    fed, unclear = F.coalesce("fed", F.lit(False)), F.coalesce("open", F.lit(False))
    arms_of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("arm"))))
    row = per_arm.agg(arms_of(~fed & ~unclear).alias("unfed"), arms_of(~fed & unclear).alias("unclear"))
    verdict = F.when(F.size("unfed") > 0, "uncovered").when(F.size("unclear") > 0, "unknown").otherwise("covered")
    told = F.array_join(F.when(F.size("unfed") > 0, F.col("unfed")).otherwise(F.col("unclear")), ", ")
    return finding(row, "union_arm", F.lit(table), F.lit(f"union[{union}]"), verdict, "high", told)


def key_facts(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row (left_rows, matched, unmatched, right_nulls): left rows by whether a non-null key match exists.

    Both sides shrink to one row per key before they meet, so no key is hot.
    """
    ls, rs = match_keys(left, right, pairs)
    keys = [f"_k{i}" for i in range(len(pairs))]
    counted = left.groupBy(*[k.alias(n) for k, n in zip(ls, keys)]).agg(F.count(F.lit(1)).alias("_n"))
    have = right.select(*[k.alias(f"_r{i}") for i, k in enumerate(rs)])
    hits = have.dropna().distinct().withColumn("_hit", F.lit(True))
    joined = counted.join(hits, all_of([F.col(n) == F.col(f"_r{i}") for i, n in enumerate(keys)]), "left")
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    nulls = F.lit(False)
    for i in range(len(pairs)):
        nulls = nulls | F.col(f"_r{i}").isNull()
    null_rows = have.agg(F.count_if(nulls).alias("n")).scalar()
    return joined.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("left_rows"),
                      number(F.col("_hit").isNotNull()).alias("matched"),
                      number(F.col("_hit").isNull()).alias("unmatched")).withColumn("right_nulls", null_rows)


def _lacks(df: DataFrame, columns: Sequence[str]) -> bool:
    have = {c.lower() for c in df.columns}
    return any(c.lower() not in have for c in columns)


def _key_audit(left, right, pairs, check, table, construct, exercised, note, tier="high"):
    missing = _lacks(left, [l for l, _ in pairs]) or _lacks(right, [r for _, r in pairs])
    if missing:  # an empty side exercises nothing; a side with rows but no key column cannot be judged
        sides = ((left, [l for l, _ in pairs]), (right, [r for _, r in pairs]))
        judged = all(df.isEmpty() for df, columns in sides if _lacks(df, columns))
        return finding(left.sparkSession.range(1), check, F.lit(table), F.lit(construct),
                       F.lit("uncovered" if judged else "unknown"), tier, F.lit("key column not given"))
    facts = key_facts(left, right, pairs)
    verdict = F.when(F.col(exercised) > 0, "covered").otherwise("uncovered")
    evidence = F.concat(F.lit("matched="), F.col("matched"), F.lit(" unmatched="), F.col("unmatched"), note)
    return finding(facts, check, F.lit(table), F.lit(construct), verdict, tier, evidence)


def audit_left_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], table: str = "model",
                    construct: str = "left_join", distinct: bool = False) -> DataFrame:
    """Does any left row lack a right match, so that NULL propagation is exercised?"""
    note = F.lit(" advice=uniqueness test on the right key") if distinct else F.lit("")
    return _key_audit(left, right, pairs, "left_join", table, construct, "unmatched", note)


def audit_anti_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], table: str = "model",
                    construct: str = "anti_join") -> DataFrame:
    """Does any left row match, so that the exclusion is exercised? Also reports NULL keys on the right."""
    note = F.concat(F.lit(" right_nulls="), F.col("right_nulls"))
    return _key_audit(left, right, pairs, "anti_join", table, construct, "matched", note)


def audit_fan_out(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Does the join repeat left rows? (left_rows, joined_rows, repeated_left_rows, max_multiplicity, fans_out)."""
    ls, rs = match_keys(left, right, pairs)
    keys = [f"_k{i}" for i in range(len(pairs))]
    lefts = left.groupBy(*[k.alias(n) for k, n in zip(ls, keys)]).agg(F.count(F.lit(1)).alias("_n"))
    rights = right.select(*[k.alias(f"_r{i}") for i, k in enumerate(rs)]).dropna()
    rights = rights.groupBy(*rights.columns).agg(F.count(F.lit(1)).alias("_m"))
    joined = lefts.join(rights, all_of([F.col(n) == F.col(f"_r{i}") for i, n in enumerate(keys)]), "left")
    many = F.coalesce("_m", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.agg(
        zero(F.sum("_n")).alias("left_rows"),
        zero(F.sum(F.col("_n") * F.greatest(many, F.lit(1)))).alias("joined_rows"),
        zero(F.sum(F.when(many > 1, F.col("_n")))).alias("repeated_left_rows"),
        zero(F.max(many)).alias("max_multiplicity")).withColumn("fans_out", F.col("max_multiplicity") > 1)


def _uniqueness(tests: DataFrame) -> DataFrame:
    return tests.filter(F.col("name").isin(*BACKING_TESTS)).select(
        "table", "test", "columns", "enabled", "severity", "where", "limit")


def degradations(severity: Column, where: Column, limit: Column) -> Column:
    level = F.lower(severity)
    causes = F.array(
        F.when(level == "warn", "warn").when(~level.isin("error", "warn"), "severity"),
        F.when(F.trim(where) != "", "where"), F.when(limit.isNotNull(), "limit"))
    return F.concat_ws(",", F.array_compact(causes))


def _backing(tests: DataFrame, keys: DataFrame) -> DataFrame:
    """Per (table, key_id): enabled backing tests, how many of them are degraded, and disabled ones.

    Tests and keys that name the same columns are folded together first, so that containment is decided between column
    sets and not between every test and every key of a table.
    """
    signature = F.array_sort(F.array_distinct(F.transform("columns", lambda c: F.lower(c))))
    weak = degradations(F.col("severity"), F.col("where"), F.col("limit")) != ""
    live = F.coalesce("enabled", F.lit(True))
    claims = _uniqueness(tests).withColumn("columns", signature).groupBy("table", "columns").agg(
        F.count_if(live).alias("backing"), F.count_if(live & weak).alias("degraded"),
        F.count_if(~live).alias("disabled"), F.min(F.when(live, F.col("test"))).alias("by")).withColumn(
        "test", F.to_json("columns"))
    signed = keys.withColumn("columns", signature)
    sets = signed.select("table", "columns").distinct().withColumn("key_id", F.to_json("columns"))
    per_set = covers(claims, sets).join(claims.drop("columns"), ["table", "test"]).groupBy("table", "key_id").agg(
        *[F.sum(n).alias(n) for n in ("backing", "degraded", "disabled")], F.min("by").alias("by"))
    return signed.select("table", "key_id", F.to_json("columns").alias("_set")).join(
        per_set.withColumnRenamed("key_id", "_set"), ["table", "_set"]).drop("_set")


def audit_unique_key(models: DataFrame, tests: DataFrame, singular: DataFrame) -> DataFrame:
    """A declared key needs an enabled uniqueness test on some of its columns.

    models (table, unique_key) where a declared but unreadable key has ``key_declared`` and no columns; singular
    (test, table, enabled).
    """
    declared = models.filter("key_declared")
    keys = declared.filter(F.size("unique_key") > 0).select("table", F.col("table").alias("key_id"),
                                                            F.col("unique_key").alias("columns"))
    loose = singular.filter(F.coalesce("enabled", F.lit(True))).select("table").distinct().withColumn("_singular", F.lit(True))
    joined = declared.join(_backing(tests, keys).drop("key_id"), "table", "left").join(loose, "table", "left")
    readable = F.coalesce(F.size("unique_key") > 0, F.lit(False))
    verdict = (F.when(~readable, "unknown").when(F.col("backing") > 0, "covered")
               .when(F.col("_singular"), "unknown").otherwise("uncovered"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    evidence = F.concat(F.lit("key="), F.coalesce(F.concat_ws(",", "unique_key"), F.lit("")), F.lit(" backing="),
                        zero("backing"), F.lit(" degraded="), zero("degraded"), F.lit(" disabled="), zero("disabled"))
    return finding(joined, "unique_key", F.col("table"), F.lit("config.unique_key"), verdict, "total", evidence)


def disabled_backing(models: DataFrame, tests: DataFrame) -> DataFrame:
    """(table, test, columns): uniqueness tests on some columns of a declared key that exist but are switched off.

    They assert nothing and never back a key, but a test that was written and disabled is a different fact than none.
    """
    keys = models.filter(F.col("key_declared") & (F.size("unique_key") > 0)).select(
        "table", F.col("table").alias("key_id"), F.col("unique_key").alias("columns"))
    off = _uniqueness(tests).filter(~F.coalesce("enabled", F.lit(True))).select("table", "test", "columns").distinct()
    return covers(off, keys).join(off, ["table", "test"]).select("table", "test", "columns").distinct()


def audit_catalog(models: DataFrame, tests: DataFrame, singular: DataFrame, unit_tests: DataFrame, constraints: DataFrame,
                  platform: Column | str | None) -> DataFrame:
    """The findings about what a catalog declares: unique keys, incremental branches and constraints."""
    found = audit_unique_key(models, tests, singular).unionByName(audit_incremental_branches(models, unit_tests))
    return found.unionByName(audit_constraints(constraints, tests, platform))


def audit_constraints(constraints: DataFrame, tests: DataFrame, platform: Column | str | None) -> DataFrame:
    """A declared primary key or unique constraint that the platform does not enforce needs a backing test.

    constraints (table, kind, columns). Repeated declarations on one column set count once. Without a platform
    there is nothing to say.
    """
    if platform is None:
        platform = F.lit(None).cast("string")
    platform = F.lit(platform) if isinstance(platform, str) else platform
    lowered = F.array_sort(F.array_distinct(F.transform("columns", lambda c: F.lower(c))))
    declared = constraints.filter(F.col("kind").isin("primary_key", "unique") & (F.size("columns") > 0)).select(
        "table", "kind", lowered.alias("columns"), platform.alias("_platform")).dropDuplicates(["table", "kind", "columns"])
    loose = declared.filter(F.col("_platform").isNotNull() & (
        support_column(F.col("_platform"), F.col("kind")) == "not_enforced"))
    loose = loose.withColumn("key_id", F.concat(F.col("kind"), F.lit("["), F.concat_ws(",", "columns"), F.lit("]")))
    joined = loose.join(_backing(tests, loose.select("table", "key_id", "columns")), ["table", "key_id"], "left")
    verdict = F.when(F.col("backing") > 0, "covered").otherwise("uncovered")
    return finding(joined, "constraint", F.col("table"), F.concat(F.lit("constraint."), F.col("key_id")), verdict,
                   "high", F.concat(F.lit("platform="), F.col("_platform")))


def audit_incremental_branches(models: DataFrame, unit_tests: DataFrame) -> DataFrame:
    """Incremental models need a unit test of each branch.

    models (table, materialized, strategy, event_time); unit_tests (test, table, incremental) where a NULL mode is a
    full build.
    """
    batch = F.coalesce(F.lower("strategy") == "microbatch", F.lit(False)) | F.col("event_time").isNotNull()
    wanted = models.filter((F.col("materialized") == "incremental") & ~batch).select("table")
    mode = F.coalesce("incremental", F.lit(False))
    modes = unit_tests.groupBy("table").agg(F.count_if(mode).alias("_inc"), F.count_if(~mode).alias("_full"))
    joined = wanted.join(modes, "table", "left")
    inc, full = F.coalesce("_inc", F.lit(0)), F.coalesce("_full", F.lit(0))
    label = (F.when((inc > 0) & (full > 0), "both").when(inc > 0, "incremental_only").when(full > 0, "full_only")
             .otherwise("none"))
    verdict = F.when(label == "both", "covered").otherwise("uncovered")
    return finding(joined, "incremental_branch", F.col("table"), F.lit("config.materialized"), verdict, "total", label)


def grain_claims(models: DataFrame, tests: DataFrame) -> DataFrame:
    """Every claim about a table's grain: (table, strength, kind, columns, origin), 1 being the strongest."""
    authored = models.filter(F.trim("meta_grain") != "").select(
        "table", F.lit(1).alias("strength"), F.lit("authored").alias("kind"), F.col("meta_grain").alias("columns"),
        F.lit("meta").alias("origin"))
    known = F.lit(False)
    for name, package in UNIQUENESS_TESTS.items():
        owner = F.col("namespace").isNull() if package is None else F.coalesce(F.col("namespace") == package, F.lit(False))
        known = known | ((F.col("name") == name) & owner)
    claims = tests.filter(known & F.coalesce("enabled", F.lit(True)) & (F.size("columns") > 0))
    strength = F.when(F.col("name") == "primary_key", 2).when(F.size("columns") >= 2, 3).otherwise(4)
    kind = F.when(strength == 2, "primary_key").when(strength == 3, "compound_unique").otherwise("unique")
    claimed = claims.select("table", strength.alias("strength"), kind.alias("kind"),
                            F.concat_ws(", ", "columns").alias("columns"), F.col("test").alias("origin"))
    return authored.unionByName(claimed)


def grain_signals(models: DataFrame, tests: DataFrame) -> DataFrame:
    """The claims of each table, ranked strongest first."""
    return number_rows(grain_claims(models, tests), ["strength", "origin"], by=["table"], name="rank")


def detect_grain(models: DataFrame, tests: DataFrame) -> DataFrame:
    """Strongest signal per table; tables without one are ``unknown``."""
    best = grain_claims(models, tests).groupBy("table").agg(
        F.min(F.struct("strength", "origin", "kind", "columns")).alias("s"), F.count(F.lit(1)).alias("signals"))
    return models.select("table").join(best, "table", "left").select(
        "table", F.coalesce("s.kind", F.lit("unknown")).alias("kind"), F.col("s.columns").alias("columns"),
        F.col("s.origin").alias("origin"), F.coalesce("signals", F.lit(0).cast("long")).alias("signals"))


def verify_grain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Check a grain on the data: rows, distinct keys, repeated keys, extra rows and rows with a NULL in the key."""
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | F.col(c).isNull()
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", nulls)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return per_key.agg(
        zero(F.sum("_n")).alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"), zero(F.sum(F.col("_n") - 1)).alias("extra_rows"),
        zero(F.sum(F.when(F.col("_null"), F.col("_n")))).alias("null_key_rows")).withColumn(
        "holds", (F.col("extra_rows") == 0) & (F.col("null_key_rows") == 0))
