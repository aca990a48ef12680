"""Incremental loads in batch: high-water filters, merges, replacement by key, event-time batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from .numbering import all_of, same

EPOCH = "1900-01-01"


class DuplicateKeyError(ValueError):
    """A merge source holds more than one row for a key."""


def high_water_filter(src: DataFrame, target: DataFrame, column: str, strict: bool = True,
                      default: str | None = EPOCH) -> DataFrame:
    """Rows of ``src`` past the target's largest ``column``; ``default`` stands in for an empty target.

    Without a default an empty target gives a NULL mark and drops every row, as the SQL does.
    """
    mark = F.max(column)
    if default is not None:
        mark = F.coalesce(mark, F.lit(default).cast(src.schema[column].dataType))
    high = target.agg(mark.alias("mark")).scalar()
    return src.filter(F.col(column) > high if strict else F.col(column) >= high)


def _without(target: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    have = src.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).distinct()
    return target.join(have, all_of([F.col(k) == F.col(f"_s{i}") for i, k in enumerate(keys)]), "left_anti")


def duplicate_keys(src: DataFrame, keys: Sequence[str]) -> DataFrame:
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_upsert(target: DataFrame, src: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Replace target rows by source rows of the same key and add the rest; a repeated source key is an error."""
    if check and not duplicate_keys(src, keys).isEmpty():
        raise DuplicateKeyError(f"merge source repeats a value of {list(keys)}")
    return _without(target, src, keys).unionByName(src)


def delete_insert(target: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop all target rows whose key occurs in the source, then insert every source row."""
    return _without(target, src, keys).unionByName(src)


def full_or_incremental(model: Callable[..., DataFrame], is_incremental: bool, this: DataFrame | None = None,
                        **inputs: DataFrame) -> DataFrame:
    """Rows the model emits in one of its two branches: all of them, or only the delta against ``this``."""
    if is_incremental and this is None:
        raise ValueError("an incremental run needs the prior state")
    return model(this=this if is_incremental else None, **inputs)


def with_period(src: DataFrame, event_time: str, period: str, name: str = "period_start") -> DataFrame:
    return src.withColumn(name, F.date_trunc(period, event_time).cast(src.schema[event_time].dataType))


def microbatch(src: DataFrame, event_time: str, period: str, start=None, end=None, name: str = "period_start") -> DataFrame:
    """Rows of the event-time periods in [start, end), each tagged with its period."""
    out = src
    if start is not None:
        out = out.filter(F.col(event_time) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(event_time) < F.lit(end))
    return with_period(out, event_time, period, name)


def replay(target: DataFrame, batch: DataFrame, name: str = "period_start") -> DataFrame:
    """Put a batch in place of the periods it covers; running it again changes nothing."""
    periods = batch.select(F.col(name).alias("_period")).distinct()
    return target.join(periods, same(F.col(name), F.col("_period")), "left_anti").unionByName(batch)


def overwrite_periods(batch: DataFrame, path: str, name: str = "period_start") -> None:
    """Write a batch over its own period partitions and leave the others alone."""
    day = F.date_format(name, "yyyy-MM-dd-HH").alias("period")
    batch.select("*", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "period").parquet(path)
