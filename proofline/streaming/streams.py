"""Structured Streaming forms of the incremental loads and data tests."""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.data_tests import DataTest, outside
from ..operators.numbering import all_of, same
from ..session import scratch_path


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def keep_latest(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; an aggregate with partial results, so that a key repeated in a batch is no hot spot."""
    row = F.struct(*batch.columns)
    latest = batch.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return latest.select("_row.*")


def drop_late(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """The rows that are not later than the watermark; equal rows all stay. The state holds a key per row until the watermark has passed it."""
    marked = stream.withWatermark(ts, watermark).withColumn("_row", F.expr("uuid()"))
    return marked.dropDuplicatesWithinWatermark(["_row"]).drop("_row")


FORMS = ("merge", "delete_insert")


def stream_upsert(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str | None = None, form: str = "merge",
                  ts: str | None = None, watermark: str | None = None, **trigger) -> StreamingQuery:
    """Upsert a stream into the table at ``path``, a parquet table partitioned by ``batch``; :func:`read_upserted` reads it.

    ``merge`` keeps the newest row per key, which Spark's own keyed state remembers, so a batch writes the keys it has changed.
    ``delete_insert`` puts every row of a batch in place of all earlier rows of its keys. A replayed batch overwrites its own
    partition, so it leaves the same table. With ``watermark`` rows that are later than it by ``ts`` are left out.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    rows = drop_late(stream, ts, watermark) if watermark else stream
    changed = keep_latest(rows, keys, order) if form == "merge" else rows

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    checkpoint = checkpoint or scratch_path(stream.sparkSession, "upsert")
    return (changed.writeStream.outputMode("update" if form == "merge" else "append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_upserted(spark: SparkSession, path: str, schema, keys: Sequence[str], order: Sequence[str], form: str = "merge") -> DataFrame:
    """The rows that are live in an upserted table; none before the first batch is written.

    The newest row per key is an aggregate with partial results. In the other form only keys and their last batch are
    grouped, and rows of a key that no longer is in an older batch are left out by an equi-join.
    """
    columns = schema.fieldNames()
    try:
        found = spark.read.option("basePath", path).schema(f"{_ddl(schema)}, batch long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if form == "merge":
        return keep_latest(found, keys, [*order, "batch"]).select(columns)
    last = found.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("batch").alias("_last"))
    matched = all_of([same(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)]) & (F.col("batch") == F.col("_last"))
    return found.join(last, matched, "left_semi").select(columns)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def compact_upserted(spark: SparkSession, path: str, to: str, schema, keys: Sequence[str], order: Sequence[str], form: str = "merge") -> None:
    """Write the live rows as one batch of a new table; a stream with the old checkpoint may go on there, as its batch numbers keep growing."""
    live = read_upserted(spark, path, schema, keys, order, form)
    newest = spark.read.option("basePath", path).schema("batch long").parquet(path).agg(F.max("batch")).first()[0]
    if newest is not None:
        live.write.mode("overwrite").parquet(f"{to}/batch={newest}")


def stream_windows(stream: DataFrame, ts: str, period: str, watermark: str, aggregates: Mapping[str, Column], by: Sequence[str] = (),
                   exact_late: bool = False) -> DataFrame:
    """Tumbling event-time windows with an aggregate per name; rows whose window the watermark has passed are dropped.

    :class:`LateRows` counts the dropped rows. They are counted where they meet the state, that is after each task has
    aggregated its own rows of a window, unless ``exact_late`` lets every row meet a state of its own first (which then
    holds a key per row of the open windows).
    """
    timed = stream.withWatermark(ts, watermark).withColumn("_window", F.window(ts, period))
    if exact_late:
        timed = timed.withColumn("_row", F.expr("uuid()")).dropDuplicates(["_row", "_window"])
    named = [column.alias(name) for name, column in aggregates.items()]
    return timed.groupBy("_window", *by).agg(*named).select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *by, *aggregates)


class LateRows(StreamingQueryListener):
    """Rows that stateful operators dropped as too late, per query, from every progress report of the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dropped, self.ended = spark, {}, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def count(self, query: StreamingQuery, timeout: float = 60) -> int:
        """The rows a query has dropped; of one that has ended, after its last report has come in."""
        if not query.isActive and not self.ended.setdefault(str(query.id), threading.Event()).wait(timeout):
            raise TimeoutError("the query's last report has not come")
        return self.dropped.get(str(query.id), 0)

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def test_batch(batch: DataFrame, tests: Sequence[DataTest]) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Good rows, quarantined rows with the names of the tests they fail, and one failure counter per test.

    A row count is judged for the batch and quarantines no row. Tests that a batch alone cannot judge (keys, references,
    free SQL) are refused.
    """
    unfit = [t.label() for t in tests if t.failing is None and t.kind != "row_count_between"]
    if unfit:
        raise ValueError(f"a micro-batch cannot judge {', '.join(unfit)}")
    seen = [F.expr(t.where) if t.where and t.where.strip() else F.lit(True) for t in tests]
    fails = [F.coalesce(s & t.failing, F.lit(False)) if t.failing is not None else F.lit(False) for s, t in zip(seen, tests)]
    names = F.array_compact(F.array(*[F.when(f, F.lit(t.label())) for f, t in zip(fails, tests)]).cast("array<string>"))
    tagged = batch.withColumn("_failed", names)
    good = tagged.filter(F.size("_failed") == 0).drop("_failed")
    bad = tagged.filter(F.size("_failed") > 0).withColumnRenamed("_failed", "failed_tests")
    counters = [F.count_if(f) if t.failing is not None else outside(F.count_if(s), *t.bounds, True).cast("long")
                for s, f, t in zip(seen, fails, tests)]
    return good, bad, [c.alias(t.label()) for c, t in zip(counters, tests)]


test_batch.__test__ = False


def stream_tests(stream: DataFrame, tests: Sequence[DataTest], good_path: str, quarantine_path: str, metrics_path: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Row tests per micro-batch: good rows, quarantine and failure counts, each keyed by batch so replays overwrite."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad, counters = test_batch(batch, tests)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        counted = batch.agg(F.count(F.lit(1)).alias("n_rows"), *counters)
        counted.write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")
        batch.unpersist()
    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    query = (df.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return query
