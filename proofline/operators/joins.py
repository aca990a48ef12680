"""Joins whose meaning is more than an equality: null-aware, null-rejecting, prefix, priority, containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import typed_key
from ..functions.scalars import leaf_name
from .numbering import all_of

SALTS = 16


def join_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equality join on differently named keys; the key comes out under the left name, coalesced where it may be missing.

    Each side is read once. Adaptive execution splits a hot key on the side whose rows are all kept.
    """
    renamed = right
    for i, (_, r) in enumerate(pairs):
        renamed = renamed.withColumnRenamed(r, f"_r{i}")
    keys = [f"_r{i}" for i in range(len(pairs))]
    out = left.join(renamed, all_of([F.col(l) == F.col(k) for (l, _), k in zip(pairs, keys)]), how)
    match = {l: k for (l, _), k in zip(pairs, keys)}
    named = [F.coalesce(F.col(c), F.col(match[c])).alias(c) if c in match and how in ("right", "full") else F.col(c) for c in left.columns]
    return out.select(*named, *[c for c in renamed.columns if c not in keys])


def anti_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Left rows without a match; NULL keys match nothing and stay. Right keys are made distinct before they travel."""
    keys = right.select(*[F.col(r).alias(f"_r{i}") for i, (_, r) in enumerate(pairs)]).distinct()
    return left.join(keys, all_of([F.col(l) == F.col(f"_r{i}") for i, (l, _) in enumerate(pairs)]), "left_anti")


not_exists = anti_join


def not_in(left: DataFrame, column: str, right: DataFrame, field: str) -> DataFrame:
    """SQL ``NOT IN``: nothing when the right side holds a NULL; a NULL on the left stays only if the right is empty.

    The NULL rule is a one-row fact about the right side, so that the join itself is an ordinary distributed
    anti join rather than the broadcast-only null-aware one.
    """
    facts = right.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count_if(F.col(field).isNull()).alias("nulls")).alias(
        "facts")).scalar()
    kept = anti_join(left, right, [(column, field)]).withColumn("_f", facts)
    keep = (F.col("_f.all") == 0) | ((F.col("_f.nulls") == 0) & F.col(column).isNotNull())
    return kept.filter(keep).select(*left.columns)


def _types(df: DataFrame) -> dict:
    return {f.name.lower(): f.dataType for f in df.schema.fields}


def match_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[list[Column], list[Column]]:
    """Comparable key columns per side: as stored when the types agree, else their canonical keys."""
    lt, rt = _types(left), _types(right)
    ls, rs = [], []
    for l, r in pairs:
        if lt[l.lower()] == rt[r.lower()]:
            ls.append(F.col(l)), rs.append(F.col(r))
        else:
            keyed = lambda c, t: F.when(F.col(c).isNotNull(), typed_key(F.col(c), t))
            ls.append(keyed(l, lt[l.lower()])), rs.append(keyed(r, rt[r.lower()]))
    return ls, rs


def key_match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], name: str = "matched") -> DataFrame:
    """Flag left rows that match some right row with every key part present on both sides and equal."""
    ls, rs = match_keys(left, right, pairs)
    keys = [f"_k{i}" for i in range(len(pairs))]
    have = right.select(*[k.alias(n) for k, n in zip(rs, keys)]).dropna().distinct().withColumn("_hit", F.lit(True))
    keyed = left.select("*", *[k.alias(f"_l{i}") for i, k in enumerate(ls)])
    joined = keyed.join(have, all_of([F.col(f"_l{i}") == F.col(n) for i, n in enumerate(keys)]), "left")
    return joined.select(*left.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def deepest_prefix(entities: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """For each (id, key) the rule with the longest prefix of the entity's path: entities (id, path), rules (prefix,
    key, value).

    Paths are looked up once however many entities share them, and as short prefixes match almost every path the
    lookups are salted over copies of the rules.
    """
    paths = entities.select("path").distinct()
    sized = paths.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    probes = sized.select("path", "_salt", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth")).withColumn(
        "prefix", F.slice("path", F.lit(1), F.col("depth")))
    copies = rules.select("prefix", "key", "value").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    best = probes.join(copies, ["prefix", "_salt"]).groupBy("path", "key").agg(
        F.max_by(F.struct("value", "depth"), "depth").alias("_w"))
    won = best.select("path", "key", F.col("_w.value").alias("value"), F.col("_w.depth").alias("depth"))
    return entities.select("id", "path").join(won, "path").select(
        "id", "key", "value", "depth", F.slice("path", F.lit(1), F.col("depth")).alias("prefix"))


def priority_lookup(requests: DataFrame, scoped: DataFrame, shared: DataFrame, packages: DataFrame) -> DataFrame:
    """Value of each (package, name): the package's own setting beats the shared one.

    A name that is itself a package is a scope and never a shared setting; a scope that is no package is ignored.
    """
    known = packages.select("package").distinct()
    own = scoped.join(known, "package", "left_semi").select("package", "name", F.col("value").alias("_own"))
    common = shared.join(known, shared["name"] == known["package"], "left_anti").select(
        "name", F.col("value").alias("_shared"))
    out = requests.join(own, ["package", "name"], "left").join(common, "name", "left")
    source = F.when(F.col("_own").isNotNull(), "package").when(F.col("_shared").isNotNull(), "global")
    return out.select("package", "name", F.coalesce("_own", "_shared").alias("value"), source.alias("precedence"))


def covers(tests: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (table, key_id, test) where the test's non-empty columns are a subset of the key's, ignoring case.

    tests (table, test, columns); keys (table, key_id, columns). Columns are matched as rows, so that a table with
    many tests and keys costs its matching columns and not their product. Column sets that repeat within a table are matched once.
    """
    fold = lambda df, ident, name: df.select("table", ident, F.sort_array(F.array_distinct(F.transform("columns", lambda c: F.lower(c)))).alias(name))
    asked, held = fold(tests, "test", "_asked").filter(F.size("_asked") > 0), fold(keys, "key_id", "_held")
    sets = lambda df, name: df.select("table", name).distinct()
    wanted = sets(asked, "_asked")
    hits = wanted.select("table", "_asked", F.explode("_asked").alias("column")).join(
        sets(held, "_held").select("table", "_held", F.explode("_held").alias("column")), ["table", "column"])
    inside = hits.groupBy("table", "_asked", "_held").agg(F.count(F.lit(1)).alias("_hits")).filter(F.col("_hits") == F.size("_asked")).drop("_hits")
    return inside.join(held, ["table", "_held"]).join(asked, ["table", "_asked"]).select("table", "key_id", "test")


def resolve_targets(refs: DataFrame, models: DataFrame) -> DataFrame:
    """Model of each (ref, target_id, target_name): the id when it is a model, else the smallest id with that leaf."""
    ids = models.select(F.col("id").alias("_id")).distinct()
    leaves = models.groupBy(leaf_name(F.col("id")).alias("_leaf")).agg(F.min("id").alias("_by_leaf"))
    return refs.join(ids, F.col("target_id") == F.col("_id"), "left").join(
        leaves, leaf_name(F.col("target_name")) == F.col("_leaf"), "left").select(
        "ref", F.coalesce("_id", "_by_leaf").alias("model"))


def changed_by_path(entities: DataFrame, changes: DataFrame, path: str = "path") -> DataFrame:
    """Entities whose path is in the change set; a rename counts under both of its names."""
    paths = changes.select("path")
    if "old_path" in changes.columns:
        paths = paths.unionByName(changes.select(F.col("old_path").alias("path")))
    touched = paths.dropna().distinct().withColumnRenamed("path", "_path")
    return entities.join(touched, F.col(path) == F.col("_path"), "left_semi")


def tagged_union(arms: dict[str, DataFrame], name: str = "arm") -> DataFrame:
    """Union by name that remembers which arm a row came from."""
    out = None
    for label, df in arms.items():
        tagged = df.withColumn(name, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged)
    return out
