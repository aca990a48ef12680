"""Cases that earlier queries did not hold."""

import pytest
from pyspark.sql import functions as F

from proofline import plans
from proofline.functions.keys import csv_key, token_key
from proofline.functions.register import register
from proofline.operators import data_tests as dt
from proofline.operators.diff import diff_tables
from proofline.operators.numbering import number_rows
from proofline.plans.base import QUERIES
from proofline.sources.catalog import explode_catalog, schema_floor
from proofline.sources.changes import explode_patch
from proofline.sources.fixtures import fixture_table
from proofline.streaming import streams as st

plans.load()


def test_composite_constraints(spark, rows):
    child = spark.createDataFrame([(1, 9), (1, 1), (None, 7), (2, None)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    declared = {"child": [dt.Constraint("foreign_key", ("a", "b"), to="parent", to_columns=("x", "y")), dt.Constraint("not_null", ("a", "b"))]}
    out = dt.verify_constraints({"child": child, "parent": parent}, declared, "databricks")
    assert rows(out.select("test", "failures")) == [("constraint_foreign_key_a_b", 1), ("constraint_not_null_a", 1), ("constraint_not_null_b", 1)]


def test_batches_judge_counts_and_refuse_keys(spark):
    batch = spark.createDataFrame([(1,), (1,)], "a int")
    good, bad, counters = st.test_batch(batch, [dt.row_count_between(5, 9), dt.row_count_between(1, 2, name="fine"), dt.between("a", 2, None, row_condition=" ")])
    assert (good.count(), bad.count()) == (0, 2)
    assert tuple(batch.agg(*counters).first()) == (1, 0, 2)
    for test in (dt.unique("a"), dt.primary_key(["a"]), dt.relationships("a", "t", "x")):
        with pytest.raises(ValueError, match="cannot judge"):
            st.test_batch(batch, [test])


@pytest.mark.parametrize("name", ["t6_stream_upsert", "t7_stream_windows", "t8_stream_tests", "t9_stream_dedup"])
def test_streams_read_a_table_of_several_files(spark, tmp_path, rows, name):
    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, one)) != []


def test_fixture_cells(spark, rows):
    out = fixture_table(spark, [{"a": "x,y", "b": "z"}, {"a": 'q"r', "b": "1\n2"}], "csv")
    assert rows(out.select("ordinal", "a.display", "b.display")) == [(0, "x,y", "z"), (1, 'q"r', "1\n2")]
    text = fixture_table(spark, "﻿a,b\n1,x\n\n\n", "csv")
    sql = fixture_table(spark, "select 1 as a, 'x' as b", "sql")
    assert text.columns == sql.columns == ["ordinal", "a", "b"] and rows(text.select("a.key", "b.key")) == rows(sql.select("a.key", "b.key"))


def test_removed_comment_and_bad_header(spark, rows):
    patch = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,1 @@\n--- old comment\n+new\n-y\n@@ -9 +8 @@\n-p\n+q\n--- a/z.sql\n+++ b/z.sql\n@@ -1 +1 @@\n-1\n+2\n@@ broken @@\n+lost\n"
    out = explode_patch(spark.createDataFrame([(1, patch)], "doc long, text string"))
    assert rows(out.hunks.select("path", "hunk", "new_start", "added_len", "removed_len")) == [("x.sql", 0, 1, 1, 2), ("x.sql", 1, 8, 1, 1), ("z.sql", 0, 1, 1, 1)]
    assert rows(out.files.select("path", "status")) == [("x.sql", "modified"), ("z.sql", "modified")]
    assert rows(out.rejected) == [(1, "z.sql", 1, "@@ broken @@")]


def test_keys_of_text_with_line_ends_and_blanks(spark):
    register(spark)
    texts = ["5\n", "05\n", "5.0\n", "\tnull\t", "5\t", " true ", "'5'", '"a\n"', "5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.orderBy("i").select(csv_key(F.col("t")).alias("c"), token_key(F.col("t")).alias("k"), F.expr("pl_csv_token(t)").alias("sc"), F.expr("pl_token(t)").alias("sk")).collect()
    assert [tuple(r.c) for r in out[:3]] == [("str", "5\n"), ("str", "05\n"), ("str", "5.0\n")]
    assert [r.sk for r in out] == ["number:5", "number:5", "number:5", "null", "number:5", "bool:true", "str:5", "str:a\n", "number:5"]
    for r in out:
        assert r.sk == (r.k.t if r.k.v is None else f"{r.k.t}:{r.k.v}") and r.sc == (r.c.t if r.c.v is None else f"{r.c.t}:{r.c.v}")


def test_maps_and_identical_rows(spark):
    old = spark.createDataFrame([(1, ({"a": 1},)), (2, ({"b": 2},))], "i int, s struct<m:map<string,int>>")
    new = spark.createDataFrame([(1, ({"a": 1},)), (2, ({"b": 3},))], "i int, s struct<m:map<string,int>>")
    assert diff_tables(old, new, order_old="i", order_new="i").summary().count() > 0
    same = spark.range(6000).select(F.lit(1).alias("x"))
    numbered = number_rows(same.repartition(4), ["x"])
    assert numbered.agg(F.sum("row_no"), F.countDistinct("row_no")).first()[0] == 6000 * 6001 // 2


def test_catalog_versions_and_broken_documents(spark, rows):
    meta = spark.createDataFrame([(i, v) for i, v in enumerate(["v12", "V11", " v12", "https://x/manifest/v9.json", None, "https://x/v12.json"])], "f int, dbt_schema_version string")
    assert rows(schema_floor(meta, ["f"], 10).select("f")) == [(3,), (4,)]
    docs = spark.createDataFrame([(1, '{"metadata": {}}'), (2, '{"metadata": '), (3, "[1]"), (4, None)], "f int, text string")
    catalog = explode_catalog(docs, ["f"])
    assert rows(catalog.rejected) == [(2,), (3,), (4,)] and catalog.metadata.count() == 1


def test_age_groups_deal_visits_out_by_condition(spark, capsys):
    QUERIES["m16_age_groups"](spark, "/root/testdata/sf0.001").explain()
    assert "REPARTITION_BY_COL" in capsys.readouterr().out
