import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import audits, contracts as ct, findings as fd, joins, snapshots as sn
from proofline.operators.governance import governance_audit
from proofline.session import scratch_path
from proofline.sources import catalog as cat
from proofline.sources.changes import explode_patch, read_change_intervals
from proofline.sources.csv import read_seed_csv
from proofline.sources.fixtures import NotTabularError, fixture_table


def test_seed_csv(spark, tmp_path, rows):
    path = tmp_path / "s.csv"
    path.write_bytes(b'id,label,flag\r\n1,"a, ""q""\nline",true\r\n2\r\n3,,false,extra\r\n')
    assert rows(read_seed_csv(spark, str(path), column_types={"id": "int"})) == [(1, 'a, "q"\nline', "true"), (2, None, None), (3, None, "false")]
    (tmp_path / "h.csv").write_text("a;b\n")
    assert read_seed_csv(spark, str(tmp_path / "h.csv"), ";").count() == 0


@pytest.mark.parametrize("size", [40, 500, 1 << 20])
def test_seed_csv_by_byte_ranges(spark, tmp_path, rows, size):
    """Fields with line ends, quotes and delimiters that fall anywhere on the borders of the ranges, in two files."""
    rng, want = random.Random(size), []
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", newline="") as out:
            write = csv.writer(out, lineterminator="\n" if part else "\r\n")
            write.writerow(["id", "no te", "x`y"])
            for i in range(300):
                row = [f"{part}-{i}", "".join(rng.choices(["a", "b c", ",", '"', "\n", "\n\n", "é", "line"], k=rng.randint(1, 12))), rng.choice(["1", "", "two"])]
                write.writerow(row[:rng.choice([2, 3, 3, 3])] + rng.choice([[], [], ["more"]]) if i % 7 == 0 else row)
        with open(tmp_path / f"{part}.csv", newline="") as back:
            want += [tuple((r + [None] * 3)[:3]) for r in list(csv.reader(back))[1:]]
    want = sorted((a, b, c or None) for a, b, c in want)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = read_seed_csv(spark, str(tmp_path))
        assert found.columns == ["id", "no te", "x`y"]
        assert sorted(tuple(r) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fixture_tables(spark):
    t = fixture_table(spark, [{"a": 1, "b": "1"}, {"b": None, "c": [1, {"x": 2}]}, {"a": 1.50, "c": True}])
    got = [tuple(r) for r in t.orderBy("ordinal").select(*[F.concat_ws(":", f"{c}.key.t", f"{c}.key.v") for c in ("a", "b", "c")]).collect()]
    assert got == [("number:1", "str:1", "absent"), ("absent", "null", 'str:[1,{"x":2}]'), ("number:1.5", "absent", "bool:true")]
    csv = fixture_table(spark, "a,b\n1.00,x\n,\n", "csv").orderBy("ordinal").select("a.key.t", "a.key.v", "b.key.t").collect()
    assert [tuple(r) for r in csv] == [("number", "1", "str"), ("null", None, "null")]
    assert fixture_table(spark, "a,b\n", "csv").count() == 0 and fixture_table(spark, None).count() == 0
    assert fixture_table(spark, "select 1 as a union all select 2", "sql").count() == 2
    with pytest.raises(NotTabularError):
        fixture_table(spark, "a,b", "dict")


PATCH = """diff --git a/models/a.sql b/models/a.sql
--- a/models/a.sql
+++ b/models/a.sql
@@ -1 +1 @@
-old
+new
@@ -9,2 +8,0 @@ ctx
-x
-y
diff --git a/old.sql b/new.sql
similarity index 100%
rename from old.sql
rename to new.sql
diff --git a/gone.sql b/gone.sql
deleted file mode 100644
--- a/gone.sql
+++ /dev/null
@@ -1 +0,0 @@
-z
diff --git a/born.sql b/born.sql
new file mode 100644
--- /dev/null
+++ b/born.sql
@@ -0,0 +1,2 @@
+p
+q
"""


def test_patch(spark, tmp_path, rows):
    (tmp_path / "p.patch").write_text(PATCH)
    found = read_change_intervals(spark, str(tmp_path / "*.patch"))
    assert rows(found.files, "path", "old_path", "status") == [("born.sql", None, "added"), ("gone.sql", None, "deleted"),
                                                                ("models/a.sql", None, "modified"), ("new.sql", "old.sql", "renamed")]
    assert rows(found.hunks, "path", "new_start", "new_len", "added_len", "removed_len") == [
        ("born.sql", 1, 2, 2, 0), ("models/a.sql", 1, 1, 1, 1), ("models/a.sql", 8, 0, 0, 2)]
    assert rows(found.lines.filter("path = 'models/a.sql'"), "side", "text") == [("added", "new"), ("removed", "old"), ("removed", "x"), ("removed", "y")]
    plain = "--- a/x.sql\r\n+++ b/x.sql\r\n@@ -1 +1,2 @@\r\n-a\r\n+b\r\n+c\r\n\\ No newline at end of file\r\n--- a/y.sql\r\n+++ b/y.sql\r\n@@ -3,0 +4 @@\r\n+d\r\n"
    found = explode_patch(spark.createDataFrame([("d", plain)], "doc string, text string"))
    assert rows(found.hunks, "path", "new_start", "new_len", "added_len", "removed_len") == [("x.sql", 1, 2, 2, 1), ("y.sql", 4, 1, 1, 0)]
    assert rows(found.lines, "side", "text") == [("added", "b"), ("added", "c"), ("added", "d"), ("removed", "a")]
    stripped = explode_patch(spark.createDataFrame([("d", PATCH)], "doc string, text string"), strip="models")
    assert "a.sql" in {r["path"] for r in stripped.files.collect()}


def test_read_catalog_is_tolerant(spark, tmp_path, rows):
    doc = {"metadata": {"dbt_schema_version": "https://x/manifest/v12.json", "project_name": "p"}, "surprise": 1,
           "nodes": {"model.p.a": {"resource_type": "model", "depends_on": {"nodes": ["source.p.s"], "macros": ["macro.p.m"]},
                                   "config": {"materialized": "table", "meta": {"k": [1]}}, "columns": {"id": {"data_type": "int", "constraints": [{"type": "not_null"}]}},
                                   "constraints": [{"type": "primary_key", "columns": ["id"]}]},
                     "test.p.t": {"resource_type": "test", "attached_node": "model.p.a", "column_name": "id", "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}}},
           "sources": {"source.p.s": {"name": "s"}}, "macros": {"macro.p.m": {"name": "m", "macro_sql": "x", "depends_on": {"macros": ["macro.p.n"]}}},
           "unit_tests": {"unit.p.u": {"model": "a", "given": [{"input": "ref('b')", "rows": [{"x": 1}]}], "expect": {"rows": []}}},
           "exposures": {"exposure.p.e": {"name": "e", "depends_on": {"nodes": ["model.p.a"]}}}, "groups": {"group.p.g": {"name": "g", "owner": {"email": "o@x"}}}}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "two.json").write_text(json.dumps({"metadata": {"dbt_schema_version": "https://x/manifest/v11.json"}}))
    found = cat.read_catalog(spark, str(tmp_path / "*.json"))
    assert rows(found.nodes, "id", "kind") == [("model.p.a", "model"), ("source.p.s", "source"), ("test.p.t", "test")]
    assert rows(found.edges, "src", "dst") == [("source.p.s", "model.p.a")]
    assert found.nodes.filter("id = 'model.p.a'").select(F.col("config")["meta"]).collect()[0][0] == '{"k":[1]}'
    assert rows(found.constraints, "kind", "columns") == [("primary_key", ["id"])] and rows(found.column_constraints, "column", "kind") == [("id", "not_null")]
    assert rows(found.given, "ordinal", "input", "rows") == [(0, "ref('b')", '[{"x":1}]')] and rows(found.macro_edges, "src", "dst") == [("macro.p.m", "macro.p.n")]
    assert rows(found.tests, "table", "column", "name") == [("model.p.a", "id", "unique")] and rows(found.groups, "group", "owner_email") == [("g", "o@x")]
    models, tests = found.nodes.filter("kind = 'model'").select("id", "compiled_code"), found.unit_tests.select("id", F.lit("model.p.a").alias("model"))
    ok, rejected = cat.catalog_gate(models, tests, found.metadata, ["file"])
    assert not ok and rejected.count() == 1
    ok, rejected = cat.catalog_gate(models, tests)
    assert not ok and rows(rejected) == [("model.p.a", "unit.p.u")]
    assert cat.catalog_gate(models.withColumn("compiled_code", F.lit("select 1")), tests)[0]


def test_catalog_entries_for_the_audits(spark, rows):
    test = lambda **more: {"resource_type": "test", "attached_node": "model.p.a", **more}
    unique = lambda column, **more: test(test_metadata={"name": "unique", "kwargs": {"column_name": column}}, **more)
    doc = {"metadata": None, "nodes": {
        "model.p.a": {"resource_type": "model", "config": {"unique_key": ["Id", "day"], "meta": {"grain": ["id", "day"]}, "materialized": "incremental"}},
        "model.p.b": {"resource_type": "model", "config": {"unique_key": "id", "meta": {"grain": {"x": 1}}, "event_time": "ts", "contract": {"enforced": "yes"}}},
        "model.p.c": {"resource_type": "model", "config": {"unique_key": ["id", 1], "meta": {"grain": " "}}},
        "model.p.d": {"resource_type": "model", "config": {"unique_key": None}}, "model.p.e": {"resource_type": "model", "config": {"unique_key": " "}},
        "model.p.f": 5,
        "test.p.on": unique("ID", config={"severity": "Warn", "where": "x > 1", "limit": 100}),
        "test.p.off": unique("day", config={"enabled": False, "limit": "many", "where": 4}),
        "test.p.both": test(test_metadata={"name": "unique_combination_of_columns", "namespace": "dbt_utils", "kwargs": {"combination_of_columns": ["day", "id"]}}),
        "test.p.odd": test(test_metadata={"name": "unique_combination_of_columns", "kwargs": {"combination_of_columns": ["day", 1]}}),
        "test.p.sql": {"resource_type": "test", "depends_on": {"nodes": ["model.p.b", "model.p.a"]}}},
        "unit_tests": {"unit.p.u": {"model": "model.p.a", "overrides": {"macros": {"is_incremental": True}}}, "unit.p.v": {"model": "model.p.a", "overrides": {"macros": {"is_incremental": "x"}}}},
        "disabled": {"test.p.gone": [unique("id"), "junk", None], "model.p.x": [{"resource_type": "model"}], "odd": 5, "test.p.alone": [{"resource_type": "test", "column_name": "id"}],
                     "test.p.level": [test(column_name="id", test_metadata={"name": "unique"})]}}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json"), (3, '{"nodes": [], "disabled": 7}'), (4, None)], "doc int, text string")
    found = cat.explode_catalog(docs, ["doc"])
    assert rows(found.rejected) == [(2,), (4,)] and rows(found.metadata.select("doc")) == [(1,), (3,)]
    assert {n: t.count() for n, t in found.where("doc = 3").tables().items()} == {n: int(n == "metadata") for n in cat.TABLES}
    assert rows(found.audit_models, "table", "key_declared", "unique_key", "event_time", "meta_grain") == [
        ("model.p.a", True, ["Id", "day"], None, "id, day"), ("model.p.b", True, ["id"], "ts", '{"x":1}'), ("model.p.c", True, None, None, None),
        ("model.p.d", False, None, None, None), ("model.p.e", True, None, None, None)]
    assert rows(found.audit_tests, "test", "columns", "enabled", "severity", "where", "limit") == [
        ("test.p.both", ["day", "id"], True, None, None, None), ("test.p.gone", ["id"], False, None, None, None), ("test.p.level", ["id"], False, None, None, None),
        ("test.p.odd", None, True, None, None, None), ("test.p.off", ["day"], False, None, None, None), ("test.p.on", ["ID"], True, "Warn", "x > 1", 100)]
    assert rows(found.disabled, "id", "kind", "table", "columns") == [
        ("model.p.x", "model", None, None), ("test.p.alone", "test", None, None), ("test.p.gone", "test", "model.p.a", ["id"]), ("test.p.level", "test", "model.p.a", ["id"])]
    assert rows(found.singular_tests, "test", "table", "enabled") == [("test.p.sql", "model.p.a", True), ("test.p.sql", "model.p.b", True)]
    assert rows(found.unit_modes, "test", "incremental") == [("unit.p.u", True), ("unit.p.v", None)]
    assert rows(found.snapshot_nodes.filter("id = 'model.p.b'"), "contract_enforced", "path") == [(False, None)]
    verdicts = audits.audit_catalog(found.audit_models, found.audit_tests, found.singular_tests, found.unit_modes, found.declared_constraints, None)
    assert rows(verdicts, "table", "check", "verdict") == [
        ("model.p.a", "incremental_branch", "covered"), ("model.p.a", "unique_key", "covered"), ("model.p.b", "unique_key", "unknown"),
        ("model.p.c", "unique_key", "unknown"), ("model.p.e", "unique_key", "unknown")]
    assert rows(audits.disabled_backing(found.audit_models, found.audit_tests), "test") == [("test.p.gone",), ("test.p.level",), ("test.p.off",)]


NODE = "id string, checksum string, config map<string,string>, relation_name string, macros array<string>, contract_enforced boolean, columns map<string,string>"


def test_snapshot_axes(spark):
    base = spark.createDataFrame([("a", "1", {"x": "1", "y": "2"}, "r", ["m", "n"], True, {"id": "int"}), ("gone", "1", {}, "r", [], None, {})], NODE)
    same = [("a", "1", {"y": "2", "x": "1"}, "r", ["n", "m", "n"], True, {"id": "int"})]
    flags = lambda rows, axes=(): {r["id"]: r for r in sn.diff_snapshots(spark.createDataFrame(rows, NODE), base, axes).collect()}
    assert not any(flags(same, sn.AXES)["a"][c] for c in ("body", *sn.AXES, "modified"))
    edited = [("a", "1", {"x": "9", "y": "2"}, "q", ["m"], None, {"id": "int"}), ("b", "1", {}, "r", [], None, {})]
    got = flags(edited, ("configs",))
    assert got["a"]["modified"] and got["a"]["relation"] and got["a"]["macros"] and got["a"]["contract"] and not got["a"]["body"]
    assert got["b"]["is_new"] and got["b"]["modified"] and not flags(edited)["a"]["modified"]
    assert [r[0] for r in sn.only_in(base, spark.createDataFrame(edited, NODE)).collect()] == ["gone"]


N, C, K = "id string, enforced boolean, checksum string, materialized string", "id string, name string, type string", "id string, column string, kind string, expression string"


@pytest.mark.parametrize("old, new, change, reasons", [
    (((None, None, "table"), [("x", "int")], []), ((True, None, "table"), [("x", "int")], []), "changed_not_breaking", set()),
    (((False, None, "table"), [], []), ((False, None, "view"), [], []), "unchanged", set()),
    (((True, None, "table"), [], []), ((False, None, "table"), [], []), "breaking", {"contract_enforcement_dropped"}),
    (((True, "k", "table"), [("x", "int")], []), ((True, "k", "table"), [], []), "unchanged", set()),
    (((True, "k", "view"), [("x", "int")], []), ((True, "j", "view"), [("x", "int4"), ("y", "text")], []), "unchanged", set()),
    (((True, None, "view"), [("x", "int"), ("z", "text")], []), ((True, None, "view"), [("x", "text")], []), "breaking", {"column_removed", "column_type_changed"}),
    (((True, None, "view"), [], [("x", "not_null", None)]), ((True, None, "view"), [], []), "unchanged", set()),
    (((True, None, "table"), [], [("x", "not_null", None), ("x", "custom", "c")]), ((True, None, "table"), [], []), "breaking", {"column_constraint_removed"}),
    (((True, None, "table"), [], [(None, "check", "a > 0")]), ((True, None, "table"), [], [(None, "check", "a > 1")]), "breaking", {"model_constraint_removed"}),
    (((True, None, "incremental"), [], [("x", "not_null", None)]), ((True, None, "view"), [], [("x", "not_null", None)]), "breaking", {"materialization_changed"}),
    (((True, None, "table"), [], []), ((True, None, "view"), [], []), "unchanged", set()),
])
def test_contract_rules(spark, old, new, change, reasons):
    make = lambda s: (spark.createDataFrame([("m", *s[0])], N), spark.createDataFrame([("m", *c) for c in s[1]], C), spark.createDataFrame([("m", *c) for c in s[2]], K))
    (on, oc, ok), (nn, nc, nk) = make(old), make(new)
    assert ct.classify_contract(on, nn, oc, nc, ok, nk).select("change").collect()[0][0] == change
    assert {r["reason"] for r in ct.contract_reasons(on, nn, oc, nc, ok, nk).collect()} == reasons


def test_support_matrix(spark):
    assert ct.constraint_support("BigQuery", "unique") == "not_supported" and ct.constraint_support("redshift", "foreign_key") == "not_enforced"
    assert ct.constraint_support("elsewhere", "check") == "not_enforced" and ct.constraint_support("databricks", "check") == "enforced"
    kinds = ["not_null", "unique", "primary_key", "foreign_key", "check", "custom"]
    df = spark.createDataFrame([(p, k) for p in [*ct.SUPPORT, "elsewhere"] for k in kinds], "p string, k string")
    for r in df.withColumn("s", ct.support_column(F.col("p"), F.col("k"))).collect():
        assert r["s"] == ct.constraint_support(r["p"], r["k"])


def test_governance(spark):
    nodes = spark.createDataFrame([("a", "model", "public", "g1", "2", "1", None), ("b", "model", "private", "g2", None, None, "2024-01-01"),
                                   ("c", "model", None, None, None, None, "bad")], "id string, kind string, access string, group string, version string, latest_version string, deprecation_date string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("b", "b2")], "src string, dst string")
    groups = spark.createDataFrame([("g1", "o@x"), ("g2", None)], "group string, owner_email string")
    contracts = spark.createDataFrame([("a", "breaking"), ("b", "breaking")], "id string, change string")
    got = governance_audit(nodes.select("id"), nodes, edges, groups, contracts, F.lit("2024-01-01").cast("date")).collect()
    assert {(r["id"], r["rule"], r["severity"]) for r in got} == {("a", "public_contract_broken", None), ("a", "version_lags_latest", None), ("a", "group_owner_touch", None),
                                                                  ("a", "ref_to_deprecated", "danger"), ("a", "access_violation", None)}


def test_deepest_prefix_and_shadowed_edits(spark, rows):
    ents = spark.createDataFrame([("m", ["p", "a", "m"]), ("n", ["p", "n"])], "id string, path array<string>")
    schema = "prefix array<string>, key string, value string"
    old = spark.createDataFrame([([], "mat", "view"), (["p", "a"], "mat", "table"), (["q"], "mat", "x"), (["p", "a"], "only", "1")], schema)
    new = spark.createDataFrame([([], "mat", "eph"), (["p", "a"], "mat", "table"), (["q"], "mat", "x")], schema)
    won = joins.deepest_prefix(ents, old)
    assert rows(won, "id", "key", "value", "depth") == [("m", "mat", "table", 2), ("m", "only", "1", 2), ("n", "mat", "view", 0)]
    impact = sn.setting_impact(won, joins.deepest_prefix(ents, new))
    assert rows(impact, "id", "key", "old", "new", "depth") == [("m", "only", "1", None, 2), ("n", "mat", "view", "eph", 0)]


def test_variables(spark, rows):
    packages = spark.createDataFrame([("p",), ("q",)], "package string")
    scoped = spark.createDataFrame([("p", "x", "own"), ("z", "x", "no package")], "package string, name string, value string")
    old, new = (spark.createDataFrame([("x", v), ("q", "a scope")], "name string, value string") for v in ("1", "2"))
    asked = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "q"), ("z", "x")], "package string, name string")
    got = {(r["package"], r["name"]): (r["value"], r["precedence"]) for r in joins.priority_lookup(asked, scoped, old, packages).collect()}
    assert got == {("p", "x"): ("own", "package"), ("q", "x"): ("1", "global"), ("q", "q"): (None, None), ("z", "x"): ("1", "global")}
    flat = lambda df: df.select(F.lit(None).cast("string").alias("scope"), "name", "value")
    edits = sn.diff_settings(flat(old), flat(new))
    masked = sn.masked_packages(edits, packages, (scoped, old), (scoped, new))
    assert rows(masked) == [("x", "p")]
    refs = spark.createDataFrame([(1, "p", "direct", "x", False), (2, "q", "direct", "x", False), (2, "q", "macro", None, True), (3, "q", "config", None, True),
                                  (4, "p", "direct", None, True)], "id int, package string, tier string, name string, dynamic boolean")
    assert rows(sn.variable_impact(edits, masked, refs, packages)) == [("x", 2, "direct"), ("x", 3, "dynamic")]


def test_scope_and_widening(spark, rows):
    models = spark.createDataFrame([("m", "m.sql", "m.yml"), ("n", "n.sql", "n.yml"), ("o", "o.sql", "o.yml")], "id string, path string, patch_path string")
    tests = spark.createDataFrame([("t1", "m", "t.yml"), ("t2", "n", "u.yml"), ("t3", None, "t.yml")], "id string, model string, path string")
    changes = spark.createDataFrame([("m.sql",), ("o.yml",), ("t.yml",)], "path string")
    scope = sn.select_scope(tests, models, changes=changes)
    assert rows(scope.models, "id") == [("m",), ("o",)] and rows(scope.tests, "id") == [("t1",), ("t3",)] and rows(scope.changed_tests, "id") == [("t1",), ("t3",)]
    wide = scope.widen(spark.createDataFrame([("n",)], "id string"))
    assert rows(wide.models, "id") == [("m",), ("n",), ("o",)] and rows(wide.tests, "id") == [("t1",), ("t2",), ("t3",)]
    assert rows(wide.changed_tests, "id") == rows(scope.changed_tests, "id")


def test_line_delta_ignores_moves(spark, rows):
    old = spark.createDataFrame([(1, "a\nb\nb"), (2, "x")], "id int, t string")
    new = spark.createDataFrame([(1, "b\na\nc"), (3, "y")], "id int, t string")
    assert rows(sn.line_delta(old, new, "id", "t")) == [(1, 1, 1), (2, 0, 1), (3, 1, 0)]


# ---- audits

def verdict(df):
    return df.select("verdict").collect()[0][0]


def test_union_arms(spark):
    one, none = spark.range(1), spark.range(0)
    assert verdict(audits.audit_union_arms({"a": ["x", "y"], "b": ["y"]}, {"x": none, "y": one})) == "covered"
    assert verdict(audits.audit_union_arms({"a": ["x"], "b": ["y"], "c": ["z"]}, {"x": none, "y": one, "z": None})) == "uncovered"
    assert verdict(audits.audit_union_arms({"b": ["y"], "c": ["z"]}, {"y": one, "z": None})) == "unknown"
    assert verdict(audits.audit_union_arms({"b": ["y", "z"]}, {"y": one, "z": None})) == "covered"


def test_join_audits(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (2,), (2,)], "b int")
    assert verdict(audits.audit_left_join(left, right, [("a", "b")])) == "covered"  # a NULL key matches nothing
    assert verdict(audits.audit_left_join(left.dropna(), right, [("a", "b")])) == "uncovered"
    assert verdict(audits.audit_anti_join(left, right, [("a", "b")])) == "covered"
    assert verdict(audits.audit_anti_join(left, right.filter("b > 5"), [("a", "b")])) == "uncovered"
    assert verdict(audits.audit_left_join(left, right, [("a", "nope")])) == "unknown"
    assert verdict(audits.audit_left_join(left, right.filter("false"), [("a", "nope")])) == "uncovered"
    text = right.select(F.concat("b", F.lit(".0")).cast("double").alias("b"))
    assert verdict(audits.audit_left_join(left.dropna(), text, [("A", "B")])) == "uncovered"  # other type and case, same keys
    assert tuple(audits.audit_fan_out(left, right, [("a", "b")]).collect()[0]) == (3, 4, 1, 2, True)
    assert tuple(audits.audit_fan_out(left.filter("false"), right, [("a", "b")]).collect()[0]) == (0, 0, 0, 0, False)


TESTS = "table string, test string, namespace string, name string, columns array<string>, enabled boolean, severity string, where string, limit int"


def test_key_audits(spark, rows):
    models = spark.createDataFrame([(t, d, k) for t, d, k in [("covered", True, ["ID", "day"]), ("bare", True, ["id"]), ("odd", True, None), ("loose", True, ["id"]),
                                                              ("none", False, None), ("off", True, ["id"])]], "table string, key_declared boolean, unique_key array<string>")
    tests = spark.createDataFrame([("covered", "t1", None, "unique", ["id"], True, "warn", None, None), ("bare", "t2", None, "unique", ["other"], True, None, None, None),
                                   ("bare", "t4", None, "unique", [], True, None, None, None), ("off", "t3", None, "unique", ["id"], False, None, None, None)], TESTS)
    singular = spark.createDataFrame([("s", "loose", None)], "test string, table string, enabled boolean")
    got = dict(rows(audits.audit_unique_key(models, tests, singular), "table", "verdict"))
    assert got == {"covered": "covered", "bare": "uncovered", "odd": "unknown", "loose": "unknown", "off": "uncovered"}
    cons = spark.createDataFrame([("covered", "primary_key", ["id"]), ("covered", "primary_key", ["ID"]), ("bare", "unique", ["id"]), ("bare", "not_null", ["id"])],
                                 "table string, kind string, columns array<string>")
    assert rows(audits.audit_constraints(cons, tests, "snowflake"), "table", "construct", "verdict") == [
        ("bare", "constraint.unique[id]", "uncovered"), ("covered", "constraint.primary_key[id]", "covered")]
    assert audits.audit_constraints(cons, tests, None).count() == 0
    assert rows(audits.audit_constraints(cons, tests, "bigquery"), "table", "verdict") == [("covered", "covered")]


def test_grain_and_branches(spark, rows):
    models = spark.createDataFrame([("a", "id"), ("b", " "), ("c", None), ("d", None)], "table string, meta_grain string")
    tests = spark.createDataFrame([("b", "z", "dbt_utils", "unique_combination_of_columns", ["x", "y"], None, None, None, None), ("b", "y", None, "unique", ["x"], True, None, None, None),
                                   ("c", "x", "other", "primary_key", ["x"], True, None, None, None), ("d", "w", "dbt_constraints", "primary_key", ["x"], True, None, None, None)], TESTS)
    assert rows(audits.detect_grain(models, tests), "table", "kind", "signals") == [("a", "authored", 1), ("b", "compound_unique", 2), ("c", "unknown", 0), ("d", "primary_key", 1)]
    inc = spark.createDataFrame([("a", "incremental", None, None), ("b", "incremental", "merge", None), ("c", "incremental", "MICROBATCH", None), ("d", "table", None, None),
                                 ("e", "incremental", None, "ts")], "table string, materialized string, strategy string, event_time string")
    units = spark.createDataFrame([("t", "a", True), ("u", "a", None), ("v", "b", True)], "test string, table string, incremental boolean")
    assert rows(audits.audit_incremental_branches(inc, units), "table", "verdict", "evidence") == [("a", "covered", "both"), ("b", "uncovered", "incremental_only")]
    assert tuple(audits.verify_grain(spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"]).collect()[0]) == (3, 2, 1, 1, 1, False)


FOUND = "check string, table string, construct string, verdict string, tier string, evidence string"


def test_findings_pipeline(spark, rows, tmp_path):
    found = spark.createDataFrame([("strong", "model.p.m", "j", "uncovered", "total", ""), ("weak", "model.p.m", "j", "uncovered", "high", ""),
                                   ("weak", "model.p.m", "k", "covered", "high", ""), ("strong", "model.p.n.v2", "j", "uncovered", "total", "")], FOUND)
    kept = fd.resolve_supersedes(found, {"strong": ["weak"], "weak": ["nothing"]})
    assert kept.count() == 3
    rules = spark.createDataFrame([(1, "strong", "m", "file", "known"), (2, "strong", "m", "inline", "later"), (3, "strong", "n", "file", "versioned")],
                                  "rank int, check string, model string, source string, reason string")
    shown = fd.apply_policy(kept, None, rules)
    assert rows(shown, "table", "construct", "suppressed", "reason") == [("model.p.m", "j", True, "known"), ("model.p.m", "k", False, None), ("model.p.n.v2", "j", True, "versioned")]
    assert not fd.gate(shown) and fd.gate(kept)
    # a check that is not displayed still supersedes
    assert not fd.gate(fd.apply_policy(kept, ["weak"], rules)) and fd.apply_policy(kept, ["weak"], rules).count() == 1
    assert tuple(fd.tally(shown).collect()[0]) == (0, 0, 0, 1) and tuple(fd.tally(found).collect()[0]) == (2, 1, 0, 1)
    path = scratch_path(spark, "f")
    for run in ("2024-01-01", "2024-01-02", "2024-01-01"):
        fd.write_findings(kept, path, run, {"project": "p"})
    assert spark.read.parquet(f"{path}/findings").count() == 2 * kept.count()
    assert spark.read.parquet(f"{path}/metadata").filter("run_date = '2024-01-01'").select("name", "value").collect() == [("project", "p")]
    policy = fd.Policy(["weak"], {"strong": ["weak"]}, rules)
    assert policy.apply([found]).count() == 1 and fd.Policy().apply([found]).filter("suppressed").count() == 0
    assert spark.read.parquet(f"{path}/findings").filter("run_date = '2024-01-01'").select("schema_version", F.col("run_date").cast("string")).distinct().collect() == [(1, "2024-01-01")]


def test_not_in(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "b int")
    left.createOrReplaceTempView("l_view")
    for values in [(), (1,), (1, None), (None,), (5,)]:
        right(*values).createOrReplaceTempView("r_view")
        want = spark.sql("select a from l_view where a not in (select b from r_view)")
        assert rows(joins.not_in(left, "a", right(*values), "b")) == rows(want), values


def test_documents_of_one_small_file_are_parsed_in_many_tasks(spark):
    from proofline.plans.q_catalog import documents
    made = documents(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_audits_of_documents_broadcast_nothing(spark, rows, capsys):
    """What is read out of variants looks small however much it is, so Spark would broadcast it."""
    body = {"model.p.a": {"resource_type": "model", "config": {"unique_key": "id"}, "constraints": [{"type": "unique", "columns": ["id"]}],
                          "columns": {"id": {"constraints": [{"type": "primary_key"}]}}},
            "test.p.on": {"resource_type": "test", "attached_node": "model.p.a", "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}}}
    found = cat.explode_catalog(spark.createDataFrame([(1, json.dumps({"nodes": body}))], "doc int, text string"), ["doc"])
    out = audits.audit_catalog(found.audit_models, found.audit_tests, found.singular_tests, found.unit_modes, found.declared_constraints, "snowflake")
    off = audits.disabled_backing(found.audit_models, found.audit_tests)
    out.explain(), off.explain()
    assert "Broadcast" not in capsys.readouterr().out and off.isEmpty()
    assert rows(out, "construct", "verdict") == [
        ("config.unique_key", "covered"), ("constraint.primary_key[id]", "covered"), ("constraint.unique[id]", "covered")]
