"""Data tests on tables: single tests with their failing rows, and whole suites in few passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from .contracts import constraint_support
from .diff import TableDiff, diff_counts, diff_tables, is_wide, row_digest
from .joins import anti_join

SEVERITIES = ("error", "warn")


@dataclass(frozen=True, eq=False)
class DataTest:
    """One declared test: ``failing`` for row predicates, ``keys`` for uniqueness, ``to`` for references."""

    kind: str
    columns: tuple[str, ...] = ()
    failing: Column | None = None
    to: str | None = None
    to_columns: tuple[str, ...] = ()
    bounds: tuple = ()
    sql: str | None = None
    where: str | None = None
    limit: int | None = None
    severity: str = "error"
    enabled: bool = True
    name: str = ""
    wide: bool = False  # kept for callers; keys of types that may be long are told by their type

    def label(self) -> str:
        return self.name or "_".join([self.kind, *self.columns])

    def degraded(self) -> list[str]:
        """Why a passing run proves less than it seems to."""
        causes = []
        if self.severity.lower() == "warn":
            causes.append("warn")
        elif self.severity.lower() not in SEVERITIES:
            causes.append("severity")
        if self.where and self.where.strip():
            causes.append("where")
        if self.limit is not None:
            causes.append("limit")
        return causes


@dataclass
class TestResult:
    __test__ = False
    failures: DataFrame
    test: DataTest

    def count(self) -> DataFrame:
        return self.failures.agg(F.count(F.lit(1)).alias("failures"))

    def store(self, path: str) -> None:
        """Persist the failing rows."""
        self.failures.write.mode("overwrite").parquet(path)


def not_null(column: str, **mods) -> DataTest:
    return DataTest("not_null", (column,), failing=F.col(column).isNull(), **mods)


def unique(column: str, **mods) -> DataTest:
    return DataTest("unique", (column,), **mods)


def unique_combination(columns: Sequence[str], **mods) -> DataTest:
    return DataTest("unique_combination", tuple(columns), **mods)


def unique_key(columns: Sequence[str], **mods) -> DataTest:
    return DataTest("unique_key", tuple(columns), **mods)


def primary_key(columns: Sequence[str], **mods) -> DataTest:
    return DataTest("primary_key", tuple(columns), **mods)


def compound_unique(columns: Sequence[str], row_condition: str | None = None, **mods) -> DataTest:
    return DataTest("compound_unique", tuple(columns), where=row_condition, **mods)


def column_unique(column: str, row_condition: str | None = None, **mods) -> DataTest:
    return DataTest("column_unique", (column,), where=row_condition, **mods)


def relationships(column: str, to: str, to_column: str, **mods) -> DataTest:
    return DataTest("relationships", (column,), to=to, to_columns=(to_column,), **mods)


def accepted_values(column: str, values: Sequence, **mods) -> DataTest:
    return DataTest("accepted_values", (column,), failing=~F.col(column).isin(*values), **mods)


def outside(value: Column | str, low, high, inclusive: bool) -> Column:
    value, out = F.col(value) if isinstance(value, str) else value, F.lit(False)
    if low is not None:
        out = out | (value < low if inclusive else value <= low)
    if high is not None:
        out = out | (value > high if inclusive else value >= high)
    return out


def accepted_range(column: str, low=None, high=None, inclusive: bool = True, **mods) -> DataTest:
    return DataTest("accepted_range", (column,), failing=outside(column, low, high, inclusive), **mods)


def between(column: str, low=None, high=None, row_condition: str | None = None, strictly: bool = False, **mods) -> DataTest:
    return DataTest("between", (column,), failing=outside(column, low, high, not strictly), where=row_condition, **mods)


def row_count_between(low: int | None = None, high: int | None = None, **mods) -> DataTest:
    return DataTest("row_count_between", bounds=(low, high), **mods)


def match_regex(column: str, pattern: str, row_condition: str | None = None, **mods) -> DataTest:
    return DataTest("match_regex", (column,), failing=~F.col(column).rlike(pattern), where=row_condition, **mods)


def singular(sql: str, **mods) -> DataTest:
    return DataTest("singular", sql=sql, **mods)


def _filtered(df: DataFrame, test: DataTest) -> DataFrame:
    return df.filter(F.expr(test.where)) if test.where and test.where.strip() else df


def _duplicates(df: DataFrame, test: DataTest) -> DataFrame:
    """Repeated keys; single-column and expectation spellings ignore NULLs, a primary key also rejects them."""
    any_null = F.lit(False)
    for c in test.columns:
        any_null = any_null | F.col(c).isNull()
    grouped = df if test.kind in ("unique_combination", "unique_key", "primary_key") else df.filter(~any_null)
    repeated = F.col("n_rows") > 1
    if test.kind == "primary_key":
        repeated = repeated | any_null
    keys = [F.col(c) for c in test.columns]
    if not any(is_wide(df, k) for k in keys):
        return grouped.groupBy(*test.columns).agg(F.count(F.lit(1)).alias("n_rows")).filter(repeated)
    # rows meet on a digest, so that a long text travels only where the failing rows themselves are asked for
    found = grouped.withColumn("_digest", row_digest(df, keys)).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.first(c).alias(c) for c in test.columns])
    return found.filter(repeated).select(*test.columns, "n_rows")


def _failures(df: DataFrame, test: DataTest, tables: Mapping[str, DataFrame]) -> DataFrame:
    if test.kind == "singular":
        return df.sparkSession.sql(test.sql)
    rows = _filtered(df, test)
    if test.failing is not None:
        return rows.filter(test.failing)
    if test.kind == "relationships":
        # a reference with a NULL in any part is not judged
        return anti_join(rows.dropna(subset=list(test.columns)), tables[test.to], list(zip(test.columns, test.to_columns, strict=True)))
    if test.kind == "row_count_between":
        low, high = test.bounds
        counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.filter(outside("n_rows", low, high, True))
    return _duplicates(rows, test)


def run_test(df: DataFrame, test: DataTest, tables: Mapping[str, DataFrame] = {}) -> TestResult:
    failures = _failures(df, test, tables)
    return TestResult(failures if test.limit is None else failures.limit(test.limit), test)


def _status(failures: Column, test: DataTest) -> Column:
    level = test.severity.lower()
    bad = {"error": "fail", "warn": "warn"}.get(level, "unknown")
    return F.when(failures > 0, bad).otherwise("pass")


def _result_columns(table: str, test: DataTest, failures: Column) -> Column:
    if test.limit is not None:
        failures = F.least(failures, F.lit(test.limit).cast("long"))
    return F.struct(
        F.lit(table).alias("table"), F.lit(test.label()).alias("test"), F.lit(test.kind).alias("kind"),
        _status(failures, test).alias("status"), failures.cast("long").alias("failures"),
        F.lit(test.severity.lower()).alias("severity"), F.lit(",".join(test.degraded())).alias("degraded"))


def run_suite(tables: Mapping[str, DataFrame], suite: Mapping[str, Sequence[DataTest]]) -> DataFrame:
    """All tests of all tables: (table, test, kind, status, failures, severity, degraded).

    Every row predicate and row count of a table is a counter in one aggregation over it, so the table is read once
    for them; only uniqueness, references and free SQL need passes of their own.
    """
    parts = []
    for table, tests in suite.items():
        df = tables[table]
        live = [t for t in tests if t.enabled]
        fused = [t for t in live if t.failing is not None or t.kind == "row_count_between"]
        if fused:
            counters = []
            for i, t in enumerate(fused):
                seen = F.expr(t.where) if t.where and t.where.strip() else F.lit(True)
                counters.append(F.count_if(seen & (t.failing if t.failing is not None else F.lit(True))).alias(f"_t{i}"))
            counted = df.agg(*counters)
            results = []
            for i, t in enumerate(fused):
                failed = F.col(f"_t{i}")
                if t.kind == "row_count_between":
                    failed = outside(f"_t{i}", *t.bounds, True).cast("long")
                results.append(_result_columns(table, t, failed))
            parts.append(counted.select(F.explode(F.array(*results)).alias("r")).select("r.*"))
        for t in live:
            if t not in fused:
                counted = _failures(df, t, tables).agg(F.count(F.lit(1)).alias("_n"))
                parts.append(counted.select(_result_columns(table, t, F.col("_n")).alias("r")).select("r.*"))
        skipped = [(table, t.label(), t.kind, "skipped", 0, t.severity.lower(), ",".join(t.degraded()))
                   for t in tests if not t.enabled]
        if skipped:
            parts.append(df.sparkSession.createDataFrame(
                skipped, "table string, test string, kind string, status string, failures long, severity string, "
                         "degraded string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Suite:
    """Declared tests per table, to be run on whatever tables are given."""

    __test__ = False
    tests: Mapping[str, Sequence[DataTest]]

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return run_suite(tables, self.tests)

    def failures(self, tables: Mapping[str, DataFrame]) -> dict[str, TestResult]:
        return {f"{t}.{test.label()}": run_test(tables[t], test, tables)
                for t, tests in self.tests.items() for test in tests if test.enabled}


@dataclass(frozen=True)
class Constraint:
    """A declared constraint; ``expression`` for checks, ``to``/``to_columns`` for foreign keys."""

    kind: str
    columns: tuple[str, ...] = ()
    expression: str | None = None
    to: str | None = None
    to_columns: tuple[str, ...] = ()


def constraint_tests(constraint: Constraint) -> list[DataTest]:
    """The tests a constraint stands for: one for each column that must not be NULL, else one."""
    if constraint.kind == "not_null":
        return [replace(not_null(c), name=f"constraint_not_null_{c}") for c in constraint.columns]
    return [_constraint_test(constraint)]


def _constraint_test(constraint: Constraint) -> DataTest:
    label = "_".join(["constraint", constraint.kind, *constraint.columns])
    if constraint.kind == "unique":
        return DataTest("unique", constraint.columns, name=label)
    if constraint.kind == "primary_key":
        return primary_key(constraint.columns, name=label)
    if constraint.kind == "foreign_key":
        return DataTest("relationships", constraint.columns, to=constraint.to, to_columns=constraint.to_columns, name=label)
    if constraint.kind == "check":
        return DataTest("check", constraint.columns, failing=~F.coalesce(F.expr(constraint.expression), F.lit(True)),
                        name=label)
    raise ValueError(f"a {constraint.kind} constraint cannot be verified")


def verify_constraints(tables: Mapping[str, DataFrame], declared: Mapping[str, Sequence[Constraint]],
                       platform: str) -> DataFrame:
    """Run declared constraints on the data; ``support`` says what the platform does about each kind."""
    suite = {t: [test for c in cs for test in constraint_tests(c)] for t, cs in declared.items()}
    support = {test.label(): constraint_support(platform, c.kind) for cs in declared.values() for c in cs for test in constraint_tests(c)}
    lookup = F.create_map(*[x for label, level in support.items() for x in (F.lit(label), F.lit(level))])
    return run_suite(tables, suite).withColumn("support", lookup[F.col("test")])


def split_quarantine(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and their complement; an unknown flag is quarantined."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def listed_columns_only(actual: DataFrame, expect: DataFrame) -> DataFrame:
    return actual.select(*expect.columns)


@dataclass
class UnitTest:
    """Given tables, the transformation's expected rows and its overrides."""

    __test__ = False
    model: Callable[..., DataFrame]
    given: Mapping[str, DataFrame]
    expect: DataFrame
    columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)  # given name -> column -> type
    variables: Mapping[str, object] = field(default_factory=dict)
    is_incremental: bool | None = None
    this: DataFrame | None = None

    def inputs(self) -> dict[str, DataFrame]:
        """Given tables with the columns the model needs but the test does not list filled with NULL."""
        out = {}
        for name, df in self.given.items():
            for column, dtype in self.columns.get(name, {}).items():
                if column not in df.columns:
                    df = df.withColumn(column, F.lit(None).cast(dtype))
            out[name] = df
        return out

    def actual(self) -> DataFrame:
        extra = dict(self.variables)
        if self.is_incremental is not None:
            extra.update(this=self.this if self.is_incremental else None)
        return listed_columns_only(self.model(**self.inputs(), **extra), self.expect)


def run_unit_test(test: UnitTest) -> DataFrame:
    """Row counts per kind between expected and actual; the test passes when all rows are unchanged."""
    return diff_counts(test.expect, test.actual())


def unit_test_diff(test: UnitTest, order: Sequence[str]) -> TableDiff:
    """The full diff, with both sides put in the given order."""
    from .numbering import number_rows
    numbered = lambda df: number_rows(df, order, name="_pos")
    return diff_tables(numbered(test.expect), numbered(test.actual()), "_pos", "_pos")


def unit_test_passes(test: UnitTest) -> bool:
    return run_unit_test(test).filter("kind <> 'unchanged'").isEmpty()
