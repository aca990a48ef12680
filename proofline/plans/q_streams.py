"""The events table as a file stream, run to completion."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators import data_tests as dt
from ..session import scratch_path
from ..streaming import streams as st
from .base import query, table


# parts of the events that come as batches of their own: by user, and by kind and amount
TURN = "((user_id + event_id) % 3)"
PART = "(case when event_type = 'error' or value < 5 then 2 when event_type = 'click' then 1 else 0 end)"


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a pattern takes the table as one file or as a folder of part files
    df = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    return df.withColumn("at", F.col("ts").cast("timestamp"))


@query("t6_stream_upsert", """
    select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1""")
def _(spark, sf):
    rows = stream(spark, sf).select("user_id", "event_id", "event_type", "ts")
    path = scratch_path(spark, "upserts")
    st.stream_upsert(rows, ["user_id"], ["ts", "event_id"], path).awaitTermination()
    return st.read_upserted(spark, path, rows.schema, ["user_id"], ["ts", "event_id"]).drop("ts")


def in_turn(spark, sf, *parts):
    """The events in several files, one per batch, in the order given; a part is a condition."""
    path, events = scratch_path(spark, "turns"), table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    for i, part in enumerate(parts):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/turn={i}")
        time.sleep(1.1)  # files are taken by age, which some file systems keep in seconds
    return st.read_parquet_stream(spark, path, f"{st._ddl(events.schema)}, turn int", 1)


@query("t6_delete_insert", f"""
    select user_id, event_id, event_type from events where {TURN} = (select max({TURN}) from events n where n.user_id = events.user_id)""")
def _(spark, sf):
    # each user's events come in three batches; those of the last one with the user replace all before
    rows = in_turn(spark, sf, *[f"{TURN} = {i}" for i in range(3)]).select("user_id", "event_id", "event_type", "ts")
    path = scratch_path(spark, "upserts")
    st.stream_upsert(rows, ["user_id"], ["ts"], path, form="delete_insert").awaitTermination()
    return st.read_upserted(spark, path, rows.schema, ["user_id"], ["ts"], "delete_insert").drop("ts")


# what the third batch is late by: rows meet the watermark that held when the batch before them was planned, so it is that of the first, in milliseconds
MARKS = f"""marks as (select 2 as k, date_trunc('milliseconds', max(ts)) as top from events where {PART} = 0)"""


@query("t6_watermark", f"""
    with {MARKS}, live as (select * from events where event_id not in (select event_id from events join marks on k = {PART} where ts <= top - interval 1 hour))
    select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from live group by 1""")
def _(spark, sf):
    # of the third batch all rows but those of the last hour are too late
    rows = in_turn(spark, sf, *[f"{PART} = {i}" for i in range(3)]).select("user_id", "event_id", "event_type", "ts", "at")
    path = scratch_path(spark, "upserts")
    st.stream_upsert(rows, ["user_id"], ["ts", "event_id"], path, ts="at", watermark="1 hour").awaitTermination()
    return st.read_upserted(spark, path, rows.schema, ["user_id"], ["ts", "event_id"]).drop("ts", "at")


@query("t7_late_rows", f"""
    with {MARKS} select count(*) as late from events join marks on k = {PART} where time_bucket(interval 1 hour, ts) + interval 1 hour <= top - interval 10 minutes""")
def _(spark, sf):
    counted = st.stream_windows(in_turn(spark, sf, *[f"{PART} = {i}" for i in range(3)]), "at", "1 hour", "10 minutes", {"n": F.count(F.lit(1))}, exact_late=True)
    late = st.LateRows(spark)
    try:
        ended = st.run_to_parquet(counted, scratch_path(spark, "windows"), scratch_path(spark, "windows-state"))
        return spark.range(1).select(F.lit(late.count(ended)).cast("long").alias("late"))
    finally:
        late.close()


@query("t7_stream_windows", """
    with w as (select time_bucket(interval 1 hour, ts) as s, event_type, count(*) as n, cast(round(sum(value * 100)) as bigint) as cents from events group by 1, 2)
    select strftime(s, '%Y-%m-%d %H:%M') as window_start, event_type, n, cents from w
    where s + interval 1 hour <= (select max(ts) from events) - interval 10 minutes""")
def _(spark, sf):
    counted = st.stream_windows(stream(spark, sf), "at", "1 hour", "10 minutes", {
        "n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("value") * 100).cast("long"))}, ["event_type"])
    path = scratch_path(spark, "windows")
    st.run_to_parquet(counted, path, scratch_path(spark, "windows-state"))
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start")
    return spark.read.parquet(path).select(start, "event_type", "n", "cents")


@query("t8_stream_tests", """
    select 'quarantined' as item, count(*) as n from events where value > 100 or event_type = 'error' and value < 1
    union all select 'good', count(*) from events where not (value > 100 or event_type = 'error' and value < 1)
    union all select 'accepted_range_value', count(*) from events where value > 100
    union all select 'errors', count(*) from events where event_type = 'error' and value < 1
    union all select 'n_rows', count(*) from events""")
def _(spark, sf):
    tests = [dt.accepted_range("value", 0, 100), dt.between("value", 1, None, row_condition="event_type = 'error'", name="errors")]
    paths = [scratch_path(spark, name) for name in ("good", "quarantine", "metrics", "tests-state")]
    st.stream_tests(stream(spark, sf), tests, *paths).awaitTermination()
    good, bad, metrics = (spark.read.parquet(p) for p in paths[:3])
    count = lambda df, item: df.agg(F.lit(item).alias("item"), F.count(F.lit(1)).alias("n"))
    sums = [metrics.agg(F.lit(c).alias("item"), F.sum(c).alias("n")) for c in ("accepted_range_value", "errors", "n_rows")]
    out = count(bad, "quarantined").unionByName(count(good, "good"))
    for part in sums:
        out = out.unionByName(part)
    return out


@query("t9_stream_dedup", "select user_id, event_type, 1::bigint as kept from events group by 1, 2")
def _(spark, sf):
    # the watermark is wider than the data, so that one row per key survives
    unique = st.stream_dedup(stream(spark, sf).select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "60 days")
    path = scratch_path(spark, "unique")
    st.run_to_parquet(unique, path, scratch_path(spark, "unique-state"))
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("kept"))
