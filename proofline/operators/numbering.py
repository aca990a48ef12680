"""Row numbers over data of any size and skew: no group and no table is ever ordered in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import cut

LONG_RUN = 10_000  # rows of one group in one range that are counted where they lie
SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in (by, order), cut into ranges that also split a single large group; ``_part`` names the range.

    The result is written out, because everything that follows must see one and the same ranges. Finding the ranges
    reads the input once more, so an input that is dear to compute should be cut first. A hash of the row splits rows that
    tie in the order, and makes their numbers repeatable; equal rows, which may take any of their numbers, are split by
    their place in the input.
    """
    hashed = [F.xxhash64(F.to_json(f"`{f.name}`") if _holds_map(f.dataType) else F.col(f"`{f.name}`")) for f in df.schema.fields
              if not isinstance(f.dataType, T.VariantType)]
    tied = df.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0)).withColumn("_row", F.monotonically_increasing_id())
    last = (*by, *order, "_tie", "_row")
    ranges = tied.repartitionByRange(*last).sortWithinPartitions(*last).drop("_tie", "_row")
    return cut(ranges.withColumn("_slot", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_slot", SLOT_BITS))


def _carry(runs: DataFrame, by: Sequence[str], total: Column) -> DataFrame:
    """What earlier ranges of the same group hand on to each range.

    Only the first group of a range can have begun in an earlier one, so there is at most one row per range.
    """
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return runs.select(*by, "_part", total.over(before).alias("_carry")).filter("_carry IS NOT NULL").select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_carry")


def _with_carry(local: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    match = all_of([same(F.col(c), F.col(f"_b{i}")) for i, c in enumerate(by)]) & (F.col("_part") == F.col("_p"))
    return local.join(F.broadcast(carry), match, "left")  # bounded by the number of ranges


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_no") -> DataFrame:
    """Add 1, 2, 3... in ``order`` within each ``by`` group; every range counts its own rows and adds what came before.

    Runs of a group within a range that are long are few, at most one per ``LONG_RUN`` rows: where they begin is sent to their rows. Only
    the rows of shorter ones move again, to be counted by windows that stay small.
    """
    ranged = _ranged(df, by, order)
    if not by:
        runs = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        local = ranged.withColumn("_local", F.col("_slot").bitwiseAND((1 << SLOT_BITS) - 1) + 1)
        return _numbered(local, runs, by, df.columns, name)
    runs = cut(ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first")), "runs")
    long = runs.filter(F.col("_n") >= LONG_RUN).select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(by)], F.col("_part").alias("_lp"), "_first")
    match = all_of([same(F.col(c), F.col(f"_l{i}")) for i, c in enumerate(by)]) & (F.col("_part") == F.col("_lp"))
    told = ranged.join(F.broadcast(long), match, "left").drop("_lp", *[f"_l{i}" for i in range(len(by))])
    near = W.partitionBy(*by, "_part")
    local = told.filter("_first IS NOT NULL").unionByName(
        told.filter("_first IS NULL").withColumn("_first", F.min("_slot").over(near))).withColumn("_local", F.col("_slot") - F.col("_first") + 1)
    return _numbered(local, runs, by, df.columns, name)


def _numbered(local: DataFrame, runs: DataFrame, by: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    joined = _with_carry(local, _carry(runs, by, F.sum("_n")), by)
    return joined.select(*columns, (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("long").alias(name))


def running_max(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], name: str = "running") -> DataFrame:
    """Largest ``value`` so far in ``order`` within each ``by`` group."""
    ranged = _ranged(df, by, order)
    runs = ranged.groupBy(*by, "_part").agg(F.max(value).alias("_m"))
    so_far = W.partitionBy(*by, "_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.max(value).over(so_far))
    joined = _with_carry(local, _carry(runs, by, F.max("_m")), by)
    return joined.select(*df.columns, F.greatest("_local", "_carry").alias(name))


def sequence_key(df: DataFrame, order: Sequence[str], sentinel: Mapping[str, object] | None = None,
                 name: str = "key", sentinel_key: int = -1) -> DataFrame:
    """Number all rows from 1 and add an unknown member; columns the sentinel does not name are NULL."""
    numbered = number_rows(df, order, name=name).select(name, *df.columns)
    if sentinel is None:
        return numbered
    cells = [F.lit(sentinel_key).cast("long").alias(name)]
    cells += [F.lit(sentinel.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return numbered.unionByName(df.sparkSession.range(1).select(*cells))


def occurrence_no(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "k") -> DataFrame:
    """Number the copies of each key in order."""
    return number_rows(df, order, by=keys, name=name)


def capped_preview(df: DataFrame, order: Sequence[Column | str], cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows, and one row saying how many there are, how many are shown and whether it capped."""
    shown = df.orderBy(*order).limit(cap)
    meta = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.least("total_rows", F.lit(cap).cast("long")).alias("shown_rows"),
        (F.col("total_rows") > cap).alias("capped"))
    return shown, meta


def top_n_with_overflow(df: DataFrame, order: Sequence[Column | str], n: int = 10) -> DataFrame:
    """First ``n`` rows; ``total`` and ``overflowed`` on each say what was left out."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total).withColumn(
        "overflowed", F.greatest(F.col("total") - n, F.lit(0)))


def dense_grid(left: DataFrame, right: DataFrame, facts: DataFrame | None = None, fill: Mapping[str, object] = {}):
    """Every pairing of the distinct rows of two dimensions, with sparse facts joined on and zero-filled.

    The pairing is the result asked for; both sides are reduced to their distinct values first.
    """
    grid = left.distinct().crossJoin(right.distinct())
    if facts is None:
        return grid
    return grid.join(facts, grid.columns, "left").fillna(dict(fill))
