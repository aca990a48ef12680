"""Comparing two snapshots of a catalog, or of any keyed table, and choosing what is in scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .intervals import interval_overlap
from .joins import changed_by_path, priority_lookup
from .numbering import same

AXES = ("configs", "relation", "macros", "contract")


def as_set(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(F.col(column), F.array())))


def as_map(column: str) -> Column:
    return F.array_sort(F.map_entries(F.col(column)))


def comparable(nodes: DataFrame) -> DataFrame:
    """One comparable value per axis: body checksum, config, relation, macro set, contract."""
    return nodes.select(
        "id", F.col("checksum").alias("body"), as_map("config").alias("configs"),
        F.col("relation_name").alias("relation"), as_set("macros").alias("macros"),
        F.struct(F.coalesce("contract_enforced", F.lit(False)).alias("enforced"), as_map("columns").alias("columns"))
        .alias("contract"))


def diff_keyed(cur: DataFrame, base: DataFrame, key: str, groups: Mapping[str, Column | str]) -> DataFrame:
    """Per current key, whether it is new and which column groups differ; a new row differs in all of them."""
    value = lambda g: g if isinstance(g, Column) else F.col(g)
    now = cur.select(key, *[value(g).alias(f"_c_{n}") for n, g in groups.items()])
    was = base.select(F.col(key).alias("_base"), *[value(g).alias(f"_b_{n}") for n, g in groups.items()])
    joined = now.join(was, F.col(key) == F.col("_base"), "left")
    fresh = F.col("_base").isNull()
    flags = [(fresh | ~same(F.col(f"_c_{n}"), F.col(f"_b_{n}"))).alias(n) for n in groups]
    return joined.select(key, fresh.alias("is_new"), *flags)


def diff_snapshots(cur: DataFrame, base: DataFrame, axes: Sequence[str] = ()) -> DataFrame:
    """Flag per axis and ``modified`` over the body and the chosen axes, in any order."""
    flags = diff_keyed(comparable(cur), comparable(base), "id", {a: a for a in ("body", *AXES)})
    chosen = F.col("body")
    for axis in AXES:
        if axis in axes:
            chosen = chosen | F.col(axis)
    return flags.withColumn("modified", chosen)


def only_in(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def changed_definitions(cur: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Keys added or in any way unequal to the baseline."""
    columns = [c for c in cur.columns if c != key]
    flags = diff_keyed(cur, base, key, {"whole": F.struct(*columns)})
    return flags.filter("whole").select(key)


def changed_bodies(cur: DataFrame, base: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Keys on both sides whose trimmed text differs."""
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    was = base.select(key, F.col(text).alias("_old"))
    return cur.join(was, key).filter(~same(clean(F.col(text)), clean(F.col("_old")))).select(key)


def lifecycle_state(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """new / modified per changed entity and removed per deleted path that no entity has.

    entities (id, path); changes (path, status) with status added, modified, deleted or renamed.
    """
    per_path = changes.groupBy("path").agg(F.bool_or(F.col("status") == "added").alias("_added"),
                                           F.bool_or(F.col("status") == "deleted").alias("_deleted"))
    live = entities.join(per_path, "path").select(
        "id", "path", F.when(F.col("_added"), "new").otherwise("modified").alias("state"))
    gone = per_path.filter("_deleted").join(entities.select("path").distinct(), "path", "left_anti").select(
        F.lit(None).cast("string").alias("id"), "path", F.lit("removed").alias("state"))
    return live.unionByName(gone)


def change_axes(entities: DataFrame, body: DataFrame, config: DataFrame, unit_test: DataFrame) -> DataFrame:
    """Per in-scope entity which of the three kinds of change reached it; every entity has a row."""
    out = entities.select("id").distinct()
    for name, df in (("body", body), ("config", config), ("unit_test", unit_test)):
        hit = df.select("id").distinct().withColumn(name, F.lit(True))
        out = out.join(hit, "id", "left")
    return out.select("id", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("body", "config", "unit_test")])


def diff_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (scope, name, value) that differ between two versions; a package scope is its own row per name."""
    before = old.select(F.col("scope").alias("_s"), F.col("name").alias("_n"), F.col("value").alias("old"))
    after = new.select("scope", "name", F.col("value").alias("new"))
    both = before.join(after, same(F.col("_s"), F.col("scope")) & (F.col("_n") == F.col("name")), "full")
    return both.filter(~same(F.col("old"), F.col("new"))).select(
        F.coalesce("scope", "_s").alias("scope"), F.coalesce("name", "_n").alias("name"), "old", "new")


def setting_impact(old: DataFrame, new: DataFrame, changed_keys: DataFrame | None = None) -> DataFrame:
    """Entities whose resolved value differs, with the deeper of the two winning prefixes; a shadowed edit has none.

    Both inputs are results of :func:`deepest_prefix`.
    """
    side = lambda df, tag: df.select("id", "key", F.struct("value", "depth", "prefix").alias(tag))
    both = side(old, "o").join(side(new, "n"), ["id", "key"], "full")
    if changed_keys is not None:
        both = both.join(changed_keys.select("key").distinct(), "key", "left_semi")
    deeper = F.when(F.coalesce("n.depth", F.lit(-1)) >= F.coalesce("o.depth", F.lit(-1)), F.col("n")).otherwise(F.col("o"))
    return both.filter(~same(F.col("o.value"), F.col("n.value"))).select(
        "id", "key", F.col("o.value").alias("old"), F.col("n.value").alias("new"),
        deeper["depth"].alias("depth"), deeper["prefix"].alias("prefix"))


def masked_packages(edits: DataFrame, packages: DataFrame, old: tuple[DataFrame, DataFrame],
                    new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(name, package) where a shared edit changes nothing, because the package resolves to the same value.

    old and new are each (scoped settings, shared settings). Only a package with a setting of its own can mask an edit, so
    only those are looked at.
    """
    shared = edits.filter("scope IS NULL").select("name").distinct()
    pinned = old[0].select("package", "name").unionByName(new[0].select("package", "name")).distinct()
    wanted = pinned.join(shared, "name", "left_semi").join(packages.select("package").distinct(), "package", "left_semi")
    before = priority_lookup(wanted, *old, packages).select("package", "name", F.col("value").alias("_old"))
    after = priority_lookup(wanted, *new, packages).select("package", "name", F.col("value").alias("_new"))
    return before.join(after, ["package", "name"]).filter(same(F.col("_old"), F.col("_new"))).select("name", "package")


def variable_impact(edits: DataFrame, masked: DataFrame, refs: DataFrame, packages: DataFrame) -> DataFrame:
    """(name, id, tier): models an edit reaches.

    edits (scope, name); masked (name, package); refs (id, package, tier, name, dynamic) with tier direct, config or
    macro. A name that is a package is a scope and no variable. A call without a literal name may mean any variable and
    is reported as ``dynamic`` unless the model also names the variable itself.
    """
    scopes = packages.select(F.col("package").alias("name")).distinct()
    shared = edits.filter("scope IS NULL").select("name").distinct().join(scopes, "name", "left_anti")
    scoped = edits.filter("scope IS NOT NULL").select("name", F.col("scope").alias("package")).distinct()
    literal = refs.filter(~F.col("dynamic")).select("name", "package", "id", "tier").distinct()
    named = literal.join(shared, "name").join(masked, ["name", "package"], "left_anti").unionByName(
        literal.join(scoped, ["name", "package"])).select("name", "id", "tier").distinct()
    opened = refs.filter("dynamic").select("id", "package").distinct()
    # every (edit, package with an open call) pair is part of the result, so pairing them is no detour
    spread = opened.select("package").distinct().crossJoin(shared).join(masked, ["name", "package"], "left_anti")
    reach = spread.select("name", "package").unionByName(scoped).distinct()
    guesses = opened.join(reach, "package").select("name", "id", F.lit("dynamic").alias("tier"))
    return named.unionByName(guesses.join(named.select("name", "id").distinct(), ["name", "id"], "left_anti"))


def insulated_tests(edits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Tests that pin a changed variable themselves: overrides (test, name)."""
    return overrides.join(edits.select("name").distinct(), "name", "left_semi").select("name", "test").distinct()


def line_delta(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Added and removed lines per document as multisets of lines; a line that only moved is neither."""
    lines = lambda df, n: df.select(key, F.explode(F.split(text, "\n")).alias("line"), F.lit(n).alias("n"))
    per_line = lines(old, -1).unionByName(lines(new, 1)).groupBy(key, F.xxhash64("line").alias("_h"), "line").agg(
        F.sum("n").alias("n"))
    return per_line.groupBy(key).agg(F.sum(F.greatest("n", F.lit(0))).alias("lines_added"),
                                     F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("lines_removed"))


class Scope:
    """What a change puts in scope. tests (id, model, changed), models (id), changed models (id)."""

    def __init__(self, tests: DataFrame, models: DataFrame, changed_models: DataFrame):
        hit = changed_models.select(F.col("id").alias("_m")).distinct().withColumn("_hit", F.lit(True))
        judged = tests.join(hit, F.col("model") == F.col("_m"), "left")
        self.tests = judged.filter(F.col("changed") | F.coalesce("_hit", F.lit(False))).select("id", "model", "changed")
        self.changed_tests = tests.filter("changed").select("id")
        tested = tests.select(F.col("model").alias("id")).dropna().distinct()
        known = models.select("id")
        with_test = self.tests.select(F.col("model").alias("id")).dropna().distinct().join(known, "id", "left_semi")
        untested = changed_models.select("id").distinct().join(known, "id", "left_semi").join(tested, "id", "left_anti")
        self.models = with_test.unionByName(untested).distinct()
        self._all_tests = tests

    def widen(self, attributed: DataFrame) -> "Scope":
        """Add entities whose resolved settings changed, and their tests; the changed set stays as it was."""
        ids = attributed.select("id").distinct()
        wide = object.__new__(Scope)
        wide.models = self.models.unionByName(ids).distinct()
        extra = self._all_tests.join(ids.withColumnRenamed("id", "model"), "model", "left_semi").select(
            "id", "model", "changed")
        wide.tests = self.tests.unionByName(extra).distinct()
        wide.changed_tests = self.changed_tests
        wide._all_tests = self._all_tests
        return wide


def select_scope(tests: DataFrame, models: DataFrame, cur: DataFrame | None = None, base: DataFrame | None = None,
                 axes: Sequence[str] = (), base_tests: DataFrame | None = None, changes: DataFrame | None = None) -> Scope:
    """Scope from a baseline snapshot, or from a set of changed paths.

    tests (id, model, path, ...); models (id, path, patch_path). With changes, a model is changed by its own path or
    by the path of its properties file.
    """
    if changes is None:
        modified = diff_snapshots(cur, base, axes).filter("modified").select("id")
        fresh = changed_definitions(tests, base_tests).select(F.col("id").alias("_t")).withColumn("changed", F.lit(True))
        flagged = tests.join(fresh, F.col("id") == F.col("_t"), "left")
        flagged = flagged.select("id", "model", F.coalesce("changed", F.lit(False)).alias("changed"))
    else:
        modified = changed_by_path(models, changes).select("id").unionByName(
            changed_by_path(models, changes, "patch_path").select("id")).distinct()
        paths = changes.select(F.col("path").alias("_path")).distinct()
        flagged = tests.join(paths, F.col("path") == F.col("_path"), "left").select(
            "id", "model", F.col("_path").isNotNull().alias("changed"))
    return Scope(flagged, models, modified)


def refine_changed(changed: DataFrame, blocks: DataFrame, hunks: DataFrame) -> DataFrame:
    """Keep changed tests whose own block is touched by a hunk; a test without a known block is kept."""
    located = changed.join(blocks, "id", "left")
    flagged = interval_overlap(located, hunks)
    return flagged.filter(F.col("touched") | F.col("block_start").isNull()).select("id")
