"""What happens to findings after the audits: supersede, display, suppress, count, gate, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bare_name, leaf_name

SCHEMA_VERSION = 1


def resolve_supersedes(findings: DataFrame, supersedes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop a finding when another one on the same (table, construct) supersedes its check; one level only."""
    pairs = [(winner, loser) for winner, losers in supersedes.items() for loser in losers if winner != loser]
    if not pairs:
        return findings
    rules = findings.sparkSession.createDataFrame(pairs, "winner string, loser string")
    beaten = findings.select("table", "construct", F.col("check").alias("winner")).distinct().join(
        F.broadcast(rules), "winner").select("table", "construct", F.col("loser").alias("check")).distinct()
    return findings.join(beaten, ["table", "construct", "check"], "left_anti").select(*findings.columns)


def apply_policy(findings: DataFrame, displayed: Sequence[str] | None, suppress: DataFrame) -> DataFrame:
    """Keep the displayed checks and mark suppressed findings with the rule's source and reason.

    suppress (rank, check, model, source, reason) names a table by id, by bare name or by versioned name; the first
    rule wins.
    """
    shown = findings if displayed is None else findings.filter(F.col("check").isin(*displayed))
    names = shown.select("check", "table").distinct().select(
        "check", "table", F.explode(F.array_distinct(F.array(
            F.col("table"), leaf_name(F.col("table")), bare_name(F.col("table"))))).alias("model"))
    rules = suppress.groupBy("check", "model").agg(F.min(F.struct("rank", "source", "reason")).alias("_rule"))
    first = names.join(rules, ["check", "model"]).groupBy("check", "table").agg(F.min("_rule").alias("_rule"))
    return shown.join(first, ["check", "table"], "left").select(
        *findings.columns, F.col("_rule").isNotNull().alias("suppressed"), F.col("_rule.source").alias("source"),
        F.col("_rule.reason").alias("reason"))


def surfaced_uncovered(findings: DataFrame):
    hidden = F.coalesce("suppressed", F.lit(False)) if "suppressed" in findings.columns else F.lit(False)
    return (F.col("verdict") == "uncovered") & ~hidden


def tally(findings: DataFrame) -> DataFrame:
    open_ = surfaced_uncovered(findings)
    return findings.agg(*[F.count_if(open_ & (F.col("tier") == t)).alias(f"{t}_uncovered") for t in (
        "total", "high", "advisory")], F.count_if(F.col("verdict") == "covered").alias("covered"))


def table_coverage(findings: DataFrame) -> DataFrame:
    return findings.groupBy("table").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (
        "covered", "uncovered", "unknown")])


def gate_verdict(findings: DataFrame) -> DataFrame:
    """One row, ``failed``: whether some finding of the total tier is uncovered and not suppressed."""
    return findings.agg(F.coalesce(F.bool_or(surfaced_uncovered(findings) & (F.col("tier") == "total")), F.lit(False)).alias("failed"))


def gate(findings: DataFrame) -> bool:
    """True when the run must fail: some finding of the total tier is uncovered and not suppressed."""
    return not findings.filter(surfaced_uncovered(findings) & (F.col("tier") == "total")).isEmpty()


def model_findings(audits: Sequence[DataFrame], supersedes: Mapping[str, Sequence[str]]) -> DataFrame:
    """All audits together, superseded ones removed; display and suppression come after."""
    out = audits[0]
    for df in audits[1:]:
        out = out.unionByName(df)
    return resolve_supersedes(out, supersedes)


@dataclass(frozen=True)
class Policy:
    """What to show, what to suppress and which checks supersede which, applied in the order evaluate, supersede,
    display, suppress."""

    displayed: Sequence[str] | None = None
    supersedes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    suppress: DataFrame | None = None

    def apply(self, audits: Sequence[DataFrame]) -> DataFrame:
        found = model_findings(audits, self.supersedes)
        rules = self.suppress
        if rules is None:
            rules = found.sparkSession.createDataFrame(
                [], "rank int, check string, model string, source string, reason string")
        return apply_policy(found, self.displayed, rules)


def write_findings(findings: DataFrame, path: str, run_date: str, meta: Mapping[str, str] = {}, fmt: str = "parquet") -> None:
    """Write ``findings`` and ``metadata`` under the path; writing a run again replaces it.

    Rows are in (table, construct, check) order within each file.
    """
    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").format(fmt).save(
            f"{path}/{name}")

    stamp = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(run_date).alias("run_date")]
    put(findings.select(*stamp, "*").sortWithinPartitions("table", "construct", "check"), "findings")
    pairs = findings.sparkSession.createDataFrame(sorted(meta.items()) or [("run_date", run_date)], "name string, value string")
    put(pairs.select(*stamp, "*"), "metadata")
