import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import intervals as iv


@pytest.mark.parametrize("seed", range(4))
def test_touches_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), s, s + rng.randint(0, 12)) for s in (rng.randint(0, 60) for _ in range(25))]
    asks = [(i, rng.choice("abc"), lo, lo + rng.randint(0, 5)) for i, lo in enumerate(rng.randint(0, 70) for _ in range(60))]
    got = iv.touches(spark.createDataFrame(asks, "id int, path string, lo int, hi int"),
                     spark.createDataFrame(spans, "path string, start int, end int"), ["path"], "lo", "hi")
    want = {i: any(p == q and s <= hi and e >= lo for q, s, e in spans) for i, p, lo, hi in asks}
    assert {r["id"]: r["touched"] for r in got.collect()} == want


def test_hot_path_and_repeated_positions(spark):
    rows = spark.range(4000).selectExpr("id", "'hot' as path", "cast(id % 5 as int) as lo", "cast(id % 5 as int) as hi")
    spans = spark.range(3000).selectExpr("'hot' as path", "2 as start", "3 as end")
    assert iv.touches(rows, spans, ["path"], "lo", "hi").filter("touched").count() == 1600


def test_deletions_touch_the_line_after(spark):
    hunks = spark.createDataFrame([("f", 5, 0, 2)], "path string, new_start int, new_len int, removed_len int")
    blocks = spark.createDataFrame([(1, "f", 6, 9), (2, "f", 7, 9), (3, "f", 1, 5), (4, "f", 1, 4)], "id int, path string, block_start int, block_end int")
    got = {r["id"]: r["touched"] for r in iv.interval_overlap(blocks, hunks).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 6), (3, "f", 7), (4, "f", None)], "id int, path string, line int")
    assert not iv.point_in_interval(points, hunks).filter("inside").count()
    old = {r["id"]: r["inside"] for r in iv.point_in_interval(points, hunks, side="old").collect()}
    assert old == {1: True, 2: True, 3: False, 4: False}


def test_anchor_points(spark):
    hunks = spark.createDataFrame([("f", 5, 2, 0)], "path string, new_start int, new_len int, removed_len int")
    points = spark.createDataFrame([
        (1, "f", 5, "right", "v1", False), (2, "f", 9, "right", "v1", False), (3, "g", 5, "right", "v1", False), (4, "f", None, "right", "v1", False),
        (5, "f", 5, "right", "v0", False), (6, "f", 5, "right", None, True), (7, "f", 5, "file", None, False)],
        "id int, path string, line int, side string, version string, outdated boolean")
    got = {r["id"]: (r["outcome"], r["within"]) for r in iv.anchor_points(points, hunks, hunks.select("path"), "v1").collect()}
    assert got == {1: ("resolved", True), 2: ("resolved", False), 3: ("path_absent", None), 4: ("outdated", None), 5: ("outdated", None),
                   6: ("outdated", None), 7: ("resolved", False)}


def test_first_interval_and_change_size(spark, rows):
    hunks = spark.createDataFrame([("f", 9, 1, 0, 4), ("f", 0, 0, 3, 0)], "path string, new_start int, new_len int, removed_len int, added_len int")
    ents = spark.createDataFrame([("a", "f"), ("b", "none")], "id string, path string")
    assert rows(iv.first_interval(ents, hunks)) == [("a", "f", 1, "old")]
    assert rows(iv.change_size(ents, hunks)) == [("a", 4, 3), ("b", 0, 0)]


@pytest.mark.parametrize("long", [1, 4, 10_000])
def test_long_runs_are_numbered_where_they_lie(spark, rows, monkeypatch, capsys, long):
    from proofline.operators import numbering
    monkeypatch.setattr(numbering, "LONG_RUN", long)
    df = spark.range(60).select((F.col("id") * 7 % 61).alias("pos"), F.when(F.col("id") < 40, "a").when(F.col("id") < 57, "b").alias("k"))
    out = numbering.number_rows(df, ["pos"], by=["k"])
    out.explain()
    # the window's exchange moves rows of short runs only; where all runs are long it moves none
    assert "_lp" in capsys.readouterr().out
    got = rows(out)
    want, seen = [], {}
    for pos, k in sorted(((i * 7 % 61, "a" if i < 40 else "b" if i < 57 else None) for i in range(60)), key=lambda r: r[0]):
        seen[k] = seen.get(k, 0) + 1
        want.append((pos, k, seen[k]))
    assert len(got) == 60 and set(got) == set(want)


def test_containment_folds_sets_that_repeat(spark, rows):
    from proofline.operators.joins import covers
    tests = spark.createDataFrame([(1, t, c) for t, c in ((10, ["A"]), (11, ["a", "A"]), (12, ["b", "a"]), (13, []), (14, ["z"]))], "table int, test int, columns array<string>")
    keys = spark.createDataFrame([(1, k, c) for k, c in ((1, ["a", "b"]), (2, ["B", "A"]), (3, ["a"]), (4, []))] + [(2, 9, ["a"])], "table int, key_id int, columns array<string>")
    out = covers(tests, keys)
    assert rows(out) == sorted((1, k, t) for k, t in ((1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 10), (3, 11)))
