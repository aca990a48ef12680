import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofline.operators import diff
from proofline.operators.numbering import capped_preview, dense_grid, number_rows, sequence_key, top_n_with_overflow


def brute(old, new, shared=True):
    """Match equal rows one for one in order, then pair what is left by position."""
    used, kinds = set(), {}
    for j, row in enumerate(new):
        hit = next((i for i, o in enumerate(old) if i not in used and o == row), None)
        if hit is not None:
            used.add(hit)
            kinds[j] = ("unchanged", None, j)
    lo = [i for i in range(len(old)) if i not in used]
    ln = [j for j in range(len(new)) if j not in kinds]
    out = list(kinds.values())
    both = min(len(lo), len(ln)) if shared else 0
    out += [("modified", i, j) for i, j in list(zip(lo, ln))[:both]]
    out += [("removed", i, None) for i in lo[both:]] + [("added", None, j) for j in ln[both:]]
    return sorted(out, key=str)


def frame(spark, rows, schema="pos long, a string, b double"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("seed", range(6))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice(["x", "y", "z", None]), rng.choice([1.0, 2.0, None])) for _ in range(n)]
    old, new = make(rng.randint(0, 25)), make(rng.randint(0, 25))
    got = diff.diff_tables(frame(spark, old), frame(spark, new), "pos", "pos")
    assert sorted([tuple(r) for r in got.rows.select("kind", "old_pos", "new_pos").collect()], key=str) == brute(old, new)
    counts = {k: n for k, n in diff.diff_counts(frame(spark, old).drop("pos"), frame(spark, new).drop("pos")).collect()}
    assert counts == {k: n for k, n in got.summary().collect()}


def test_no_change_against_itself_and_reordered(spark):
    rows = [("a", 1.0), ("b", 2.0), ("b", 2.0), (None, None)]
    t = frame(spark, rows)
    backwards = t.withColumn("pos", -F.col("pos"))
    for other in (t, backwards):
        found = diff.diff_tables(t, other, "pos", "pos")
        assert found.has_real_change().collect()[0][0] is False
        assert not found.cells().filter("changed").count()


def test_reformatted_numbers_are_no_change(spark):
    old = spark.createDataFrame([(0, "1"), (1, "1.50"), (2, "TRUE")], "pos int, x string")
    new = spark.createDataFrame([(0, "1.00"), (1, "1.5"), (2, "true")], "pos int, x string")
    assert diff.diff_tables(old, new, "pos", "pos", typing="csv").summary().collect() == [("unchanged", 3)]
    assert diff.diff_tables(old, new, "pos", "pos").summary().collect() == [("modified", 3)]
    wider = spark.createDataFrame([(0, 1)], "pos int, x int"), spark.createDataFrame([(0, 1.0)], "pos int, x double")
    assert diff.diff_tables(*wider, "pos", "pos").summary().collect() == [("unchanged", 1)]


def test_text_and_number_differ(spark):
    found = diff.diff_tables(spark.createDataFrame([(0, "1")], "pos int, x string"), spark.createDataFrame([(0, 1)], "pos int, x int"), "pos", "pos")
    assert found.summary().collect() == [("modified", 1)]


def test_added_column_makes_absent_cells(spark, rows):
    old = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, x string")
    new = spark.createDataFrame([(0, "a", None), (1, "b", "n")], "pos int, x string, y string")
    found = diff.diff_tables(old, new, "pos", "pos")
    assert found.columns == [("x", "present"), ("y", "added")]
    assert rows(found.cells(), "column", "old_key.t", "new_key.t", "changed") == [
        ("x", "str", "str", False), ("x", "str", "str", False), ("y", "absent", "null", True), ("y", "absent", "str", True)]
    assert diff.diff_counts(old.drop("pos"), new.drop("pos")).collect() == [("modified", 2)]


def test_no_shared_column_splits_pairs(spark):
    old, new = spark.createDataFrame([(0, "a")], "pos int, x string"), spark.createDataFrame([(0, "a")], "pos int, y string")
    assert dict(diff.diff_tables(old, new, "pos", "pos").summary().collect()) == {"added": 1, "removed": 1}
    assert dict(diff.diff_counts(old.drop("pos"), new.drop("pos")).collect()) == {"added": 1, "removed": 1}


def test_many_tables_in_one_job(spark):
    old = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (2, 0, 0, "a")], "test int, ordinal int, pos int, x string")
    new = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 1, "a"), (2, 0, 0, "c")], "test int, ordinal int, pos int, x string")
    found = diff.diff_test_data(old, new, "test", "ordinal", "pos")
    assert sorted(map(tuple, found.summary().collect())) == [(1, 0, "unchanged", 2), (2, 0, "modified", 1)]
    assert diff.changed_tables(found).collect() == [(2, 0)]


def test_unknown_group_and_time_order(spark):
    old = spark.sql("select * from values (cast(null as int), timestamp_ntz'2024-01-01 00:00:00.1', 'a') as t(g, at, x)")
    new = spark.sql("select * from values (cast(null as int), timestamp_ntz'2024-01-01 00:00:00.2', 'b') as t(g, at, x)")
    found = diff.diff_tables(old, new, "at", "at", by=["g"])
    assert found.summary().collect() == [(None, "modified", 1)]
    assert found.rows.select((F.col("old_pos") < F.col("new_pos"))).collect() == [(True,)]


def test_hot_repeated_row(spark):
    old = spark.range(3000).select(F.col("id").alias("pos"), F.lit("same").alias("x"))
    new = spark.range(2999).select(F.col("id").alias("pos"), F.when(F.col("id") == 5, "edit").otherwise("same").alias("x"))
    found = diff.diff_tables(old, new, "pos", "pos")
    assert dict(found.summary().collect()) == {"unchanged": 2998, "modified": 1, "removed": 1}
    assert found.rows.filter("kind = 'modified'").select("old_pos", "new_pos").collect() == [(2998, 5)]


def test_nested_cells_compare_as_json(spark):
    make = lambda v: spark.createDataFrame([(0, v)], "pos int, x array<int>")
    assert diff.diff_tables(make([1, 2]), make([1, 2]), "pos", "pos").summary().collect() == [("unchanged", 1)]
    assert diff.diff_tables(make([1, 2]), make([2, 1]), "pos", "pos").summary().collect() == [("modified", 1)]


def test_number_rows_with_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    got = number_rows(df, ["id"], by=["k"], name="n").collect()
    seen = {}
    for k, i, n in sorted(got, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        assert n == seen[k]
    assert len(got) == 5000


def test_number_rows_spreads_ties(spark):
    df = spark.range(3000).select(F.lit("hot").alias("k"), F.lit(1).alias("o"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    got = number_rows(df, ["o"], by=["k"], name="n")
    assert sorted(r["n"] for r in got.select("n").collect()) == list(range(1, 3001))
    again = number_rows(df.orderBy(F.desc("id")), ["o"], by=["k"], name="n")
    assert got.select("id", "n").exceptAll(again.select("id", "n")).count() == 0


def test_number_rows_null_group_and_empty(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, v int")
    assert sorted(number_rows(df, ["v"], by=["k"]).collect(), key=str) == sorted([(None, 1, 1), (None, 3, 2), ("a", 2, 1)], key=str)
    assert number_rows(df.filter("false"), ["v"]).count() == 0


def test_sequence_key_and_sentinel(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "payer_id string, amount double")
    assert sorted(map(tuple, sequence_key(df, ["payer_id"], {"payer_id": "UNKNOWN"}).collect())) == [
        (-1, "UNKNOWN", None), (1, "a", 2.0), (2, "b", 1.0)]


def test_previews_and_overflow(spark):
    df = spark.range(12)
    shown, meta = capped_preview(df, ["id"], 5)
    assert shown.count() == 5 and meta.collect() == [(12, 5, True)]
    top = top_n_with_overflow(df, [F.desc("id")], 10).collect()
    assert len(top) == 10 and {(r["total"], r["overflowed"]) for r in top} == {(12, 2)}
    assert {r["overflowed"] for r in top_n_with_overflow(df.limit(3), ["id"], 10).collect()} == {0}


def test_dense_grid_fills_zeros(spark, rows):
    months = spark.createDataFrame([(202401,), (202401,), (202402,)], "month int")
    states = spark.createDataFrame([("MA",), ("CT",), ("MA",)], "state string")
    facts = spark.createDataFrame([(202401, "MA", 3)], "month int, state string, n int")
    assert rows(dense_grid(months, states, facts, {"n": 0})) == [(202401, "CT", 0), (202401, "MA", 3), (202402, "CT", 0), (202402, "MA", 0)]


def test_rows_with_texts_meet_on_digests(spark, rows):
    """Values that would be one text if they were just put together are different rows, and no text is a key of an exchange."""
    kinds = "pos int, a string, b string, c binary, d timestamp, e decimal(9,2), f array<int>"
    at = datetime.datetime(2024, 1, 1)
    old = [(0, "x", "y", b"1", at, Decimal("1.50"), [1]), (1, None, "x", None, None, None, None), (2, "1:", "", b"", None, None, []), (3, "same", None, b"q", at, None, [2])]
    new = [(0, "xy", "", b"1", at, Decimal("1.50"), [1]), (1, "x", None, None, None, None, None), (2, "1", ":", b"", None, None, []), (3, "same", None, b"q", at, None, [2])]
    out = diff.diff_tables(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds), "pos", "pos")
    assert rows(out.summary()) == [("modified", 3), ("unchanged", 1)]
    assert rows(diff.diff_counts(spark.createDataFrame(old, kinds).drop("pos"), spark.createDataFrame(new, kinds).drop("pos"))) == [("modified", 3), ("unchanged", 1)]
