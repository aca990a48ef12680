"""Catalog documents (one JSON object per snapshot) to normalised tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

MIN_SCHEMA_VERSION = 12
SECTIONS = ("nodes", "sources", "unit_tests", "macros", "exposures", "groups")
TABLES = ("metadata", "nodes", "edges", "columns", "column_constraints", "constraints", "tests", "unit_tests", "given", "macros",
          "macro_edges", "exposures", "groups", "disabled", "rejected")
NODE_TEXT = ("name", "path", "original_file_path", "patch_path", "relation_name", "database", "schema", "alias", "raw_code",
             "compiled_code", "group", "access", "version", "latest_version", "deprecation_date")


def get(value: Column | str, path: str, kind: str = "string") -> Column:
    """What lies at a path below a variant; NULL where there is nothing, or nothing of that kind. Objects and arrays read as
    text give their JSON."""
    return F.try_variant_get(value, path, kind)


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).isin(*kinds), F.lit(False))


def _text_at(value: Column | str, path: str) -> Column:
    """A string, and NULL where another kind of value lies at the path."""
    return F.when(_is(get(value, path, "variant"), "STRING"), get(value, path))


def _names(value: Column) -> Column:
    """The strings of an array of strings, else NULL."""
    return F.when(_is(value, "ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, "$", "array<string>"))


def test_columns(body: Column | str) -> Column:
    """The columns a uniqueness test asserts together, NULL for other tests and where they cannot be read."""
    own = F.coalesce(_text_at(body, "$.test_metadata.kwargs.column_name"), _text_at(body, "$.column_name"))
    several = _names(get(body, "$.test_metadata.kwargs.combination_of_columns", "variant"))
    listed = F.coalesce(*[_names(get(body, f"$.test_metadata.kwargs.{k}", "variant")) for k in ("column_names", "column_list")])
    named = F.when(own.isNotNull(), F.array(own))
    name = get(body, "$.test_metadata.name")
    return F.when(name == "unique", named).when(name == "unique_combination_of_columns", several).when(
        name.isNotNull(), F.coalesce(several, listed, named))


def entries(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per entry of any section of any document: (keys..., section, id, body), body being a variant.

    Each document is parsed once and spread by one explode. The section "disabled" has a row per object in the lists of that
    map, whatever else they hold is passed over; "metadata" has one row per document and "rejected" one per text that is no object.
    """
    part = lambda name: F.coalesce(get("_doc", f"$.{name}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    row = lambda section, name, body: F.struct(F.lit(section).alias("section"), name.alias("id"), body.alias("body"))
    none = F.lit(None).cast("string")
    listed = lambda name: F.transform(F.map_entries(part(name)), lambda e: row(name, e["key"], e["value"]))
    spread = [listed(name) for name in SECTIONS]
    disabled = F.flatten(F.transform(F.map_entries(part("disabled")), lambda e: F.transform(
        F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>")),
        lambda body: row("disabled", e["key"], body))))
    alone = F.array(row("metadata", none, get("_doc", "$.metadata", "variant")))
    sound = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    rows = F.when(sound, F.concat(alone, *spread, disabled)).otherwise(F.array(row("rejected", none, F.lit(None).cast("variant"))))
    parsed = docs.select(*keys, F.try_parse_json(text).alias("_doc"))
    out = parsed.select(*keys, F.explode(rows).alias("_e")).select(*keys, "_e.section", "_e.id", "_e.body")
    return out.filter((F.col("section") != "disabled") | F.schema_of_variant("body").startswith("OBJECT"))


class Catalog:
    """Normalised tables over the entries of documents; every one starts with the key columns of its document.

    Their joins are merged: Spark takes a variant for 2 KB, so a few names read out of variants look a hundred times smaller than the
    entries, and tables of any size would be broadcast through the driver.
    """

    def __init__(self, entries: DataFrame, keys: list[str]):
        self.entries, self.keys = entries, list(keys)

    def where(self, condition: Column | str) -> "Catalog":
        """The documents a condition on the key columns picks."""
        return Catalog(self.entries.filter(condition), self.keys)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def _section(self, *names: str) -> DataFrame:
        return self.entries.filter(F.col("section").isin(*names)).hint("merge")

    def _of_nodes(self, path: str, kind: str, *names: str) -> DataFrame:
        return self._section("nodes").select(*self.keys, "id", F.explode(get("body", path, kind)).alias(*names))

    @cached_property
    def metadata(self) -> DataFrame:
        return self._section("metadata").select(*self.keys, *[
            get("body", f"$.{c}").alias(c) for c in ("dbt_schema_version", "project_name", "adapter_type")])

    @cached_property
    def nodes(self) -> DataFrame:
        own = self._section("nodes", "sources")
        enforced = get("body", "$.config.contract.enforced", "variant")
        return own.select(
            *self.keys, "id", get("body", "$.package_name").alias("package"), get("body", "$.checksum.checksum").alias("checksum"),
            get("body", "$.depends_on.macros", "array<string>").alias("macros"), *[get("body", f"$.{c}").alias(c) for c in NODE_TEXT],
            *[get("body", f"$.{c}", "array<string>").alias(c) for c in ("fqn", "tags")],
            *[get("body", f"$.{c}", "map<string,string>").alias(c) for c in ("config", "unrendered_config")],
            F.coalesce(get("body", "$.resource_type"), F.when(F.col("section") == "sources", "source")).alias("kind"),
            F.when(_is(enforced, "BOOLEAN"), get("body", "$.config.contract.enforced", "boolean")).alias("contract_enforced"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._of_nodes("$.depends_on.nodes", "array<string>", "src").select(*self.keys, "src", F.col("id").alias("dst"))

    @cached_property
    def _columns(self) -> DataFrame:
        return self._of_nodes("$.columns", "map<string,variant>", "column", "c")

    @cached_property
    def columns(self) -> DataFrame:
        return self._columns.select(*self.keys, "id", "column", get("c", "$.data_type").alias("type"),
                                    get("c", "$.description").alias("description"), get("c", "$.tags", "array<string>").alias("tags"))

    @cached_property
    def column_constraints(self) -> DataFrame:
        each = self._columns.select(*self.keys, "id", "column", F.explode(get("c", "$.constraints", "array<variant>")).alias("k"))
        return each.select(*self.keys, "id", "column", get("k", "$.type").alias("kind"), get("k", "$.expression").alias("expression"))

    @cached_property
    def constraints(self) -> DataFrame:
        return self._of_nodes("$.constraints", "array<variant>", "k").select(
            *self.keys, "id", get("k", "$.type").alias("kind"), get("k", "$.columns", "array<string>").alias("columns"),
            get("k", "$.expression").alias("expression"))

    @cached_property
    def tests(self) -> DataFrame:
        own = self._section("nodes").filter(get("body", "$.resource_type") == "test")
        return own.select(
            *self.keys, F.col("id").alias("test"), get("body", "$.attached_node").alias("table"), get("body", "$.column_name").alias("column"),
            get("body", "$.test_metadata.namespace").alias("namespace"), get("body", "$.test_metadata.name").alias("name"),
            get("body", "$.test_metadata.kwargs", "map<string,string>").alias("kwargs"),
            get("body", "$.config", "map<string,string>").alias("config"))

    @cached_property
    def unit_tests(self) -> DataFrame:
        fields = ("name", "model", "tested_node_unique_id", "original_file_path", "overrides")
        names = ("name", "target_name", "target_id", "path", "overrides")
        return self._section("unit_tests").select(
            *self.keys, "id", *[get("body", f"$.{f}").alias(n) for f, n in zip(fields, names)],
            get("body", "$.expect", "struct<format:string,rows:string,fixture:string>").alias("expect"))

    @cached_property
    def given(self) -> DataFrame:
        each = self._section("unit_tests").select(*self.keys, "id", F.posexplode(get("body", "$.given", "array<variant>")).alias("ordinal", "g"))
        return each.select(*self.keys, "id", "ordinal", *[get("g", f"$.{c}").alias(c) for c in ("input", "format", "rows", "fixture")])

    @cached_property
    def macros(self) -> DataFrame:
        fields = {"name": "name", "package_name": "package", "macro_sql": "text", "original_file_path": "path"}
        return self._section("macros").select(*self.keys, "id", *[get("body", f"$.{f}").alias(n) for f, n in fields.items()])

    @cached_property
    def macro_edges(self) -> DataFrame:
        return self._section("macros").select(*self.keys, F.col("id").alias("src"), F.explode(get("body", "$.depends_on.macros", "array<string>")).alias("dst"))

    @cached_property
    def exposures(self) -> DataFrame:
        return self._section("exposures").select(
            *self.keys, "id", get("body", "$.name").alias("name"), get("body", "$.type").alias("type"),
            get("body", "$.owner.email").alias("owner_email"), get("body", "$.depends_on.nodes", "array<string>").alias("upstream"))

    @cached_property
    def groups(self) -> DataFrame:
        return self._section("groups").select(*self.keys, get("body", "$.name").alias("group"), get("body", "$.owner.email").alias("owner_email"))

    @cached_property
    def disabled(self) -> DataFrame:
        """Entries that are switched off. Only a generic test still names its table; a singular one, or a model, does not."""
        fields = {"resource_type": "kind", "name": "name", "original_file_path": "path", "attached_node": "table", "column_name": "column",
                  "test_metadata.namespace": "namespace", "test_metadata.name": "test_name"}
        return self._section("disabled").select(*self.keys, "id", *[get("body", f"$.{f}").alias(n) for f, n in fields.items()],
                                                test_columns("body").alias("columns"))

    @cached_property
    def rejected(self) -> DataFrame:
        """Documents that are no JSON object."""
        return self._section("rejected").select(*self.keys)

    # ---- what the audits and comparisons take

    @cached_property
    def audit_models(self) -> DataFrame:
        """(table, key_declared, unique_key, materialized, strategy, event_time, meta_grain); a declared key that is neither a name nor a
        list of names has no ``unique_key``."""
        key, grain = get("body", "$.config.unique_key", "variant"), get("body", "$.config.meta.grain", "variant")
        text = get("body", "$.config.unique_key")
        several = _names(grain)
        full = F.when(F.size(F.filter(several, lambda c: F.trim(c) == "")) == 0, several)
        told = F.when(_is(grain, "STRING"), F.when(F.trim(get("body", "$.config.meta.grain")) != "", get("body", "$.config.meta.grain"))).otherwise(
            F.coalesce(F.array_join(F.when(F.size(full) > 0, full), ", "), get("body", "$.config.meta.grain")))
        return self._section("nodes").filter(get("body", "$.resource_type") == "model").select(
            *self.keys, F.col("id").alias("table"), (key.isNotNull() & ~_is(key, "VOID")).alias("key_declared"),
            F.when(_is(key, "STRING"), F.when(F.trim(text) != "", F.array(text))).otherwise(_names(key)).alias("unique_key"),
            _text_at("body", "$.config.materialized").alias("materialized"), _text_at("body", "$.config.incremental_strategy").alias("strategy"),
            get("body", "$.config.event_time").alias("event_time"), told.alias("meta_grain"))

    @cached_property
    def audit_tests(self) -> DataFrame:
        """Generic tests (table, test, namespace, name, columns, enabled, severity, where, limit), with those of the disabled map."""
        flag, limit = get("body", "$.config.enabled", "variant"), get("body", "$.config.limit", "variant")
        live = F.when(F.col("section") == "disabled", F.lit(False)).otherwise(
            F.coalesce(F.when(_is(flag, "BOOLEAN"), get("body", "$.config.enabled", "boolean")), F.lit(True)))
        generic = self._section("nodes", "disabled").filter((get("body", "$.resource_type") == "test") & get("body", "$.test_metadata.name").isNotNull())
        return generic.select(
            *self.keys, get("body", "$.attached_node").alias("table"), F.col("id").alias("test"), get("body", "$.test_metadata.namespace").alias("namespace"),
            get("body", "$.test_metadata.name").alias("name"), test_columns("body").alias("columns"), live.alias("enabled"),
            get("body", "$.config.severity").alias("severity"), _text_at("body", "$.config.where").alias("where"),
            F.when(_is(limit, "BIGINT"), get("body", "$.config.limit", "bigint")).alias("limit"))

    @cached_property
    def singular_tests(self) -> DataFrame:
        """Tests that are a query of their own (test, table, enabled), with each table they depend on."""
        flag = get("body", "$.config.enabled", "variant")
        own = self._section("nodes").filter((get("body", "$.resource_type") == "test") & get("body", "$.test_metadata.name").isNull())
        return own.select(*self.keys, F.col("id").alias("test"), F.explode(get("body", "$.depends_on.nodes", "array<string>")).alias("table"),
                          F.coalesce(F.when(_is(flag, "BOOLEAN"), get("body", "$.config.enabled", "boolean")), F.lit(True)).alias("enabled"))

    @cached_property
    def unit_modes(self) -> DataFrame:
        """Unit tests (test, table, incremental) by the branch they run; NULL is a full build."""
        path = "$.overrides.macros.is_incremental"
        return self._section("unit_tests").select(
            *self.keys, F.col("id").alias("test"), F.coalesce(get("body", "$.tested_node_unique_id"), get("body", "$.model")).alias("table"),
            F.when(_is(get("body", path, "variant"), "BOOLEAN"), get("body", path, "boolean")).alias("incremental"))

    @cached_property
    def declared_constraints(self) -> DataFrame:
        """Constraints of tables and of single columns alike (table, kind, columns)."""
        own = self.constraints.select(*self.keys, F.col("id").alias("table"), "kind", "columns")
        single = self.column_constraints.select(*self.keys, F.col("id").alias("table"), "kind", F.array("column").alias("columns"))
        return own.unionByName(single).hint("merge")  # a union hides the hints below it

    @cached_property
    def snapshot_nodes(self) -> DataFrame:
        """Models as snapshot and contract comparisons take them: config, columns and macros as values, ``enforced`` as well."""
        types = F.transform_values(get("body", "$.columns", "map<string,variant>"), lambda _, c: F.try_variant_get(c, "$.data_type", "string"))
        models = self._section("nodes").filter(get("body", "$.resource_type") == "model")
        enforced = F.coalesce(F.when(_is(get("body", "$.config.contract.enforced", "variant"), "BOOLEAN"), get("body", "$.config.contract.enforced", "boolean")), F.lit(False))
        return models.select(
            *self.keys, "id", get("body", "$.checksum.checksum").alias("checksum"), get("body", "$.config", "map<string,string>").alias("config"),
            get("body", "$.relation_name").alias("relation_name"), get("body", "$.depends_on.macros", "array<string>").alias("macros"),
            enforced.alias("contract_enforced"), enforced.alias("enforced"), types.alias("columns"),
            _text_at("body", "$.config.materialized").alias("materialized"), get("body", "$.original_file_path").alias("path"),
            get("body", "$.patch_path").alias("patch_path"))

    @cached_property
    def contract_columns(self) -> DataFrame:
        return self.columns.select(*self.keys, "id", F.col("column").alias("name"), "type")

    @cached_property
    def contract_constraints(self) -> DataFrame:
        """(id, column, kind, expression); the table's own constraints have no column, and their columns count as the expression."""
        said = F.concat_ws(" ", F.array_join("columns", ","), "expression")
        own = self.constraints.select(*self.keys, "id", F.lit(None).cast("string").alias("column"), "kind", said.alias("expression"))
        return own.unionByName(self.column_constraints.select(*self.keys, "id", "column", "kind", "expression")).hint("merge")

    @cached_property
    def scope_tests(self) -> DataFrame:
        """Unit tests (id, model, path) with what they say (name, given and expected rows), for choosing a scope."""
        return self._section("unit_tests").select(
            *self.keys, "id", F.coalesce(get("body", "$.tested_node_unique_id"), get("body", "$.model")).alias("model"),
            get("body", "$.original_file_path").alias("path"), get("body", "$.given").alias("given"), get("body", "$.expect").alias("expect"),
            get("body", "$.overrides").alias("overrides"))


def explode_catalog(docs: DataFrame, keys: list[str], text: str = "text") -> Catalog:
    """Split documents (keys..., text) into tables; fields that are missing are NULL, unknown ones are ignored.

    The documents are parsed once, into a written table of entries that all tables read. A text that is no JSON object, or that names
    one key twice, is rejected.
    """
    return Catalog(cut(entries(docs, keys, text), "catalog"), keys)


def read_catalog(spark: SparkSession, glob: str) -> Catalog:
    """Catalog tables of every document the path matches, keyed by file."""
    docs = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return explode_catalog(docs, ["file"])


def schema_floor(metadata: DataFrame, keys: list[str], floor: int = MIN_SCHEMA_VERSION) -> DataFrame:
    """Documents whose schema version is missing or below the floor."""
    version = F.regexp_extract("dbt_schema_version", r"(?i)(?:^|/)\s*v([0-9]+)", 1).try_cast("int")
    return metadata.select(*keys, version.alias("version")).filter(F.coalesce(F.col("version") < floor, F.lit(True)))


def uncompiled(models: DataFrame, tests: DataFrame) -> DataFrame:
    """In-scope models (id, compiled_code) without compiled code, each with the first test it affects."""
    first = tests.groupBy(F.col("model").alias("id")).agg(F.min("id").alias("first_test"))
    bare = F.coalesce(F.trim("compiled_code") == "", F.lit(True))
    return models.filter(bare).join(first, "id", "left").select("id", "first_test")


def catalog_gate(models: DataFrame, tests: DataFrame, metadata: DataFrame | None = None, keys: list[str] = ()) -> tuple[bool, DataFrame]:
    """(ok, rejected): nothing may be below the schema floor or uncompiled."""
    if metadata is not None:
        old = schema_floor(metadata, list(keys))
        if not old.isEmpty():
            return False, old
    rejected = uncompiled(models, tests)
    return rejected.isEmpty(), rejected
