import os

import pytest
from pyspark.sql import functions as F

from proofline.operators import data_tests as dt, incremental as inc
from proofline.session import scratch_path
from proofline.streaming import streams as st

SCHEMA = "k int, v int, at timestamp"


def put(spark, folder, name, rows):
    values = ", ".join(f"({k}, {v}, timestamp'{at}')" for k, v, at in rows)
    spark.sql(f"select * from values {values} as t(k, v, at)").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


BATCHES = (
    [(1, 1, "2024-01-01 00:05:00"), (2, 1, "2024-01-01 00:10:00"), (1, 2, "2024-01-01 02:00:00")],
    [(1, 9, "2024-01-01 03:30:00"), (2, 1, "2024-01-01 02:30:00")],
    [(3, 1, "2024-01-01 00:20:00")],
)


@pytest.fixture
def feed(spark, tmp_path):
    """One file per trigger: keys are replaced and repeated, and the last row comes far too late."""
    (tmp_path / "in").mkdir()
    for i, batch in enumerate(BATCHES):
        put(spark, tmp_path, f"part{i}", batch)
        written = next((tmp_path / f"part{i}").glob("*.parquet"))
        target = tmp_path / "in" / f"{i}.parquet"
        target.write_bytes(written.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    return st.read_parquet_stream(spark, str(tmp_path / "in"), SCHEMA, 1)


def test_upsert_replay_and_compaction(spark, feed, rows):
    schema, path, state = spark.createDataFrame([], SCHEMA).schema, scratch_path(spark, "up"), scratch_path(spark, "us")
    read = lambda at=path: rows(st.read_upserted(spark, at, schema, ["k"], ["at", "v"]), "k", "v")
    assert read() == []
    for _ in range(2):  # nothing new comes the second time
        st.stream_upsert(feed, ["k"], ["at", "v"], path, state).awaitTermination()
        assert read() == [(1, 9), (2, 1), (3, 1)]
    spark.read.parquet(f"{path}/batch=1").write.parquet(f"{path}/batch=7")  # what a batch says twice
    assert read() == [(1, 9), (2, 1), (3, 1)]
    other = scratch_path(spark, "up")
    st.compact_upserted(spark, path, other, schema, ["k"], ["at", "v"])
    assert read(other) == [(1, 9), (2, 1), (3, 1)] and spark.read.parquet(other).select("batch").distinct().collect() == [(7,)]


def test_upsert_leaves_late_rows_out(spark, feed, rows):
    schema, path = spark.createDataFrame([], SCHEMA).schema, scratch_path(spark, "up")
    st.stream_upsert(feed, ["k"], ["at", "v"], path, ts="at", watermark="10 minutes").awaitTermination()
    assert rows(st.read_upserted(spark, path, schema, ["k"], ["at", "v"]), "k", "v") == [(1, 9), (2, 1)]


def test_delete_insert_takes_all_rows_of_the_last_batch(spark, feed, rows):
    schema, path = spark.createDataFrame([], SCHEMA).schema, scratch_path(spark, "up")
    st.stream_upsert(feed, ["k"], ["at"], path, form="delete_insert").awaitTermination()
    assert rows(st.read_upserted(spark, path, schema, ["k"], ["at"], "delete_insert"), "k", "v") == [(1, 9), (2, 1), (3, 1)]
    both = spark.createDataFrame([(1, 4, None), (1, 4, None), (None, 5, None), (None, 6, None)], schema)
    both.write.parquet(f"{path}/batch=9")
    assert rows(st.read_upserted(spark, path, schema, ["k"], ["at"], "delete_insert"), "k", "v") == [(1, 4), (1, 4), (2, 1), (3, 1), (None, 5), (None, 6)]
    with pytest.raises(ValueError, match="form"):
        st.stream_upsert(feed, ["k"], ["at"], path, form="other")


def test_windows_drop_late_rows(spark, feed, rows):
    late = st.LateRows(spark)
    for exact in (False, True):
        path = scratch_path(spark, "w")
        counted = st.stream_windows(feed, "at", "1 hour", "10 minutes", {"n": F.count(F.lit(1))}, exact_late=exact)
        query = st.run_to_parquet(counted, path, scratch_path(spark, "ws"))
        got = spark.read.parquet(path).select(F.date_format("window_start", "HH:mm"), "n")
        assert rows(got) == [("00:00", 2), ("02:00", 2)]
        assert late.count(query) == 1
    late.close()


def test_late_rows_of_many_batches(spark, tmp_path):
    """More batches than a query keeps reports of; every second one has two late rows of one window and key."""
    folder, n = tmp_path / "many", 104
    folder.mkdir()
    put(spark, tmp_path, "now", [(1, 1, "2024-01-02 00:05:00")])
    put(spark, tmp_path, "late", [(1, 1, "2024-01-01 00:05:00"), (1, 2, "2024-01-01 00:06:00")])
    for i in range(n):
        source = next((tmp_path / ("late" if i % 2 else "now")).glob("*.parquet"))
        target = folder / f"{i:03d}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    late = st.LateRows(spark)
    try:
        counted = st.stream_windows(st.read_parquet_stream(spark, str(folder), SCHEMA, 1), "at", "1 hour", "10 minutes", {"n": F.count(F.lit(1))}, exact_late=True)
        query = st.run_to_parquet(counted, scratch_path(spark, "w"), scratch_path(spark, "ws"))
        assert late.count(query) == n - 2 and len(query.recentProgress) < n  # the second batch still meets no watermark
    finally:
        late.close()
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_tests_quarantine(spark, feed):
    paths = [scratch_path(spark, n) for n in ("g", "q", "m", "s")]
    st.stream_tests(feed, [dt.accepted_range("v", 0, 5), dt.not_null("k")], *paths).awaitTermination()
    good, bad, metrics = (spark.read.parquet(p) for p in paths[:3])
    assert good.count() == 5 and bad.select("failed_tests").collect() == [(["accepted_range_v"],)]
    assert metrics.agg(F.sum("n_rows"), F.sum("accepted_range_v"), F.sum("not_null_k")).collect() == [(6, 1, 0)]


def test_stream_dedup(spark, feed):
    path = scratch_path(spark, "d")
    st.run_to_parquet(st.stream_dedup(feed, ["k"], "at", "1 day"), path, scratch_path(spark, "ds"))
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_incremental_rules(spark, rows):
    target = spark.sql("select * from values (1, date'2024-01-01'), (1, date'2024-01-02'), (2, date'2024-01-01') as t(k, d)")
    src = spark.sql("select * from values (1, date'2024-01-05'), (3, date'2024-01-02') as t(k, d)")
    assert inc.high_water_filter(src, target, "d").count() == 1 and inc.high_water_filter(src, target, "d", strict=False).count() == 2
    empty = target.filter("false")
    assert inc.high_water_filter(src, empty, "d").count() == 2 and inc.high_water_filter(src, empty, "d", default=None).count() == 0
    assert rows(inc.delete_insert(target, src, ["k"]), "k") == [(1,), (2,), (3,)]
    assert inc.merge_upsert(target, src, ["k"]).count() == 3
    with pytest.raises(inc.DuplicateKeyError):
        inc.merge_upsert(src, target, ["k"])
    with pytest.raises(ValueError):
        inc.full_or_incremental(lambda this: this, True)


def test_microbatch_replay_and_overwrite(spark, rows):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-01 05:00:00', 1), (timestamp_ntz'2024-01-02 05:00:00', 2) as t(ts, v)")
    target = inc.with_period(df, "ts", "day")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    batch = inc.microbatch(df.withColumn("v", F.col("v") * 10), "ts", "day", day("2024-01-02"), day("2024-01-03"))
    once = inc.replay(target, batch)
    assert rows(once, "v") == [(1,), (20,)] and rows(inc.replay(once, batch), "v") == [(1,), (20,)]
    path = scratch_path(spark, "periods")
    for part in (target, batch, batch):
        inc.overwrite_periods(part, path)
    assert rows(spark.read.parquet(path), "v") == [(1,), (20,)]
