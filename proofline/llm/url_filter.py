"""URL filters: prefix rules as nested intervals of reversed-host keys, met by a sorted sweep over rules and urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import running_max

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty where the url is NULL or holds no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of the same host that contain it, itself included: what is open when the sweep passes its start."""
    prefix = F.explode(F.sequence(F.lit(0), F.length("_path")))
    opened = rules.select("_rhost", "_path", prefix.alias("_n")).withColumn("_p", F.expr("substring(_path, 1, _n)"))
    outer = rules.select("_rhost", F.col("_path").alias("_p"), F.struct(
        F.length("_path").alias("n"), F.col("_path").alias("path"), "rule", "verdict").alias("_one"))
    return opened.join(outer, ["_rhost", "_p"]).groupBy("_rhost", "_path").agg(F.collect_list("_one").alias("_stack"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per input row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict`` (``allow`` or ``block``). A rule fits its host and all subdomains where the
    url's path starts with the rule's; the longest rule wins, among equally long ones that with the longer host. Of two
    rules with one host and path ``block`` counts. A url that no rule fits gets ``default`` and a NULL rule. A NULL url, or
    one without ``://``, has an empty host and path. Rules with a NULL in any column are ignored.

    Every url enters the sweep once for each tail of its host that is no deeper than the deepest rule; the sweep is a
    running maximum over sorted ranges whose value carries the stack of open rules, so no rule is ever paired with the
    urls it does not contain and a hot host is cut into as many ranges as it needs.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(
        F.concat(F.array_join(_labels(F.translate("host", UPPER, LOWER)), "."), F.lit(".")).alias("_rhost"),
        F.col("path").alias("_path"), F.concat("host", "path").alias("rule"), "verdict")
    depth = rules.select(F.max(F.size(F.split("_rhost", "\\.")) - 1)).first()[0] or 1
    host, path = parse_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_page"), host.alias("_host"), path.alias("_path"))
    rows = rows.groupBy("_page", "_host", "_path").agg(F.count(F.lit(1)).alias("_copies"))
    labels = _labels(F.col("_host"))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))),
                        lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    points = rows.select("_page", "_host", "_copies", "_path", F.explode(tails).alias("_rhost"))
    starts = _stacks(rules).select("_rhost", "_path", F.struct("_rhost", "_path", "_stack").alias("_open"))
    events = points.withColumn("_kind", F.lit(1)).unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    swept = running_max(events, "_open", ["_rhost", "_path", "_kind", "_page", "_host"], [], name="_top").filter("_kind = 1")
    fits = F.filter(F.col("_top")["_stack"], lambda r: F.startswith(F.col("_path"), r["path"]))
    best = F.when(F.col("_top")["_rhost"] == F.col("_rhost"), F.array_max(fits))
    hit = F.when(best.isNotNull(), F.struct(
        (F.length("_rhost") + best["n"]).alias("size"), F.length("_rhost").alias("deep"), best["rule"].alias("rule"),
        best["verdict"].alias("verdict")))
    won = swept.withColumn("_hit", hit).groupBy("_page", "_host", "_path").agg(
        F.max("_hit").alias("_hit"), F.max("_copies").alias("_copies"))
    return won.select(
        F.col("_page").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_hit")["rule"].alias("rule"),
        F.coalesce(F.col("_hit")["verdict"], F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_c")).drop("_c")
