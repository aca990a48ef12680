"""Reports of the care project over facts and dimensions given as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bucket
from ..operators.numbering import sequence_key

# Edges and labels of the report buckets.
AGE_GROUPS = ((18, "0-17"), (35, "18-34"), (50, "35-49"), (65, "50-64"))
AGE_LAST = "65+"
PANEL_SIZES = ((0, "0"), (10, "1-10"), (50, "11-50"), (100, "51-100"))
PANEL_LAST = "100+"
UNKNOWN_PAYER = {"payer_id": "UNKNOWN", "payer_name": "Unknown Payer"}


def age_group(age: Column) -> Column:
    return bucket(age, AGE_GROUPS, AGE_LAST)


def panel_size(count: Column) -> Column:
    return bucket(count, PANEL_SIZES, PANEL_LAST, inclusive=True)


def top_rows(facts: DataFrame, dims: Sequence[tuple[DataFrame, str]], columns: Sequence[Column | str],
             order: Sequence[Column], n: int) -> DataFrame:
    """Join a fact to its dimensions, keep the leading rows of the order."""
    out = facts
    for dim, key in dims:
        out = out.join(dim, key)
    return out.select(*columns).orderBy(*order).limit(n)


def above_average(facts: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Rows above a multiple of the mean of each column."""
    means = facts.agg(F.struct(*[F.avg(c).alias(c) for c in factors]).alias("m")).scalar()
    keep = F.lit(True)
    for column, factor in factors.items():
        keep = keep & (F.col(column) > F.col("_m")[column] * factor)
    return facts.withColumn("_m", means).filter(keep).drop("_m")


def recent(facts: DataFrame, column: str, as_of: Column, years: int = 1) -> DataFrame:
    return facts.filter(F.col(column) >= F.add_months(as_of, -12 * years))


def entity_profile(facts: DataFrame, by: Sequence[str], item: str, active: Column, at_least: int) -> DataFrame:
    """Entities with enough distinct items, and how many of their rows are active."""
    return facts.groupBy(*by).agg(F.count_distinct(item).alias("item_count"),
                                  F.count_if(active).alias("active_count")).filter(F.col("item_count") >= at_least)


def dim_payers(payers: DataFrame, order: str = "payer_id") -> DataFrame:
    """Payers numbered from 1, and an unknown member at -1."""
    return sequence_key(payers, [order], UNKNOWN_PAYER, name="payer_key")


def month_grid_rows(dates: DataFrame, column: str = "date_actual") -> DataFrame:
    d = F.col(column)
    return dates.select((F.year(d) * 100 + F.month(d)).alias("month_key"), F.year(d).alias("year_actual"),
                        F.month(d).alias("month_actual")).distinct()
