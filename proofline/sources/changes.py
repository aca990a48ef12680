"""Unified diffs to hunk rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import normalize_path


@dataclass
class Changes:
    """``hunks`` (doc, path, hunk, new_start, new_len, added_len, removed_len), ``lines`` with their text, ``files``
    (doc, path, old_path, status), ``rejected`` (doc, path, hunk, header) with hunks whose header cannot be read."""

    hunks: DataFrame
    lines: DataFrame
    files: DataFrame
    rejected: DataFrame


HUNK = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"
FILE = "\x01"  # put before the headers of a file in a plain patch


def _owed(hunk: Column, group: int) -> Column:
    """Lines of one side that a hunk's header announces; NULL where it cannot be read."""
    told = F.regexp_extract(hunk, HUNK, group)
    return F.when(hunk.rlike(HUNK), F.when(told == "", F.lit(1)).otherwise(told.try_cast("int")))


def _mark_files(text: Column) -> Column:
    """Mark where the files of a plain patch begin.

    No line of a hunk's body begins with "@@ ", so a patch is cut there without doubt. Only a piece's last two lines may then be the
    next file's headers. They are lines of the hunk if with them it has just the lines its header announces on both sides.
    """
    def mark(piece: Column, i: Column) -> Column:
        body = F.slice(F.split(piece, "\n"), 2, F.size(F.split(piece, "\n")))
        shaped = F.forall(body, lambda l: l.rlike(r"^($|[-+ \\])"))
        number = lambda sign: F.size(F.filter(body, lambda l: l.rlike(rf"^($|[{sign} ])")))
        inside = shaped & (number("-") == _owed(piece, 1)) & (number("+") == _owed(piece, 2))
        headers = F.regexp_replace(piece, r"(^|\n)(--- [^\n]*\n\+\+\+ [^\n]*)$", rf"$1{FILE}$2")
        return F.when((i > 0) & F.coalesce(inside, F.lit(False)), piece).otherwise(headers)

    return F.array_join(F.transform(F.split(F.regexp_replace(text, FILE, ""), r"\n(?=@@ )"), mark), "\n")


def explode_patch(docs: DataFrame, doc: str = "doc", text: str = "text", strip: str | None = None) -> Changes:
    """Rows of a patch corpus (doc, text), one document per file section.

    A document is cut at its file headers and hunk headers by ``split``, so that a line's place never depends on an
    ordering across rows: a section becomes a row, a hunk becomes a row, a line becomes a row.
    """
    lines = F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n"))
    # a plain patch has no git headers and its files begin at the old-side path
    cuts = F.when(lines.contains("\ndiff --git "), F.split(lines, r"\n(?=diff --git )")).otherwise(F.split(_mark_files(lines), rf"\n{FILE}"))
    sections = docs.select(F.col(doc).alias("doc"), F.posexplode(cuts).alias("section", "body")).filter(
        F.col("body").rlike("^(diff --git |--- )"))
    grab = lambda pattern: F.nullif(F.regexp_extract("head", pattern, 1), F.lit(""))
    parts = sections.select("doc", "section", F.split("body", r"\n(?=@@ )").alias("p")).select(
        "doc", "section", F.element_at("p", 1).alias("head"), F.slice("p", 2, F.size("p")).alias("raw"))
    head = parts.select(
        "doc", "section", "raw", "head", grab(r"(?m)^\+\+\+ (?:b/)?([^\t\n]*)").alias("new"),
        grab(r"(?m)^--- (?:a/)?([^\t\n]*)").alias("old"), grab(r"(?m)^rename from (.*)$").alias("from"),
        grab(r"(?m)^rename to (.*)$").alias("to"), grab(r"^diff --git a/.* b/(.*)").alias("git"))
    gone, born = F.col("new") == "/dev/null", F.col("old") == "/dev/null"
    status = (F.when(F.col("from").isNotNull(), "renamed")
              .when(gone | F.col("head").rlike(r"(?m)^deleted file mode"), "deleted")
              .when(born | F.col("head").rlike(r"(?m)^new file mode"), "added").otherwise("modified"))
    named = head.select(
        "doc", "section", "raw", status.alias("status"),
        normalize_path(F.coalesce(F.when(gone, F.col("old")).otherwise(F.col("new")), F.col("to"), F.col("git")),
                       strip).alias("path"),
        normalize_path(F.col("from"), strip).alias("old_path"))
    # a deleted file is known by its path alone
    spread = named.filter("status <> 'deleted'").select("doc", "path", F.posexplode("raw").alias("hunk", "text"))
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    bad = F.regexp_extract("text", header, 1).try_cast("int").isNull()
    rejected = spread.filter(bad).select("doc", "path", "hunk", F.substring_index("text", "\n", 1).alias("header"))
    spread = spread.filter(~bad)
    size = F.regexp_extract("text", header, 2)
    body = F.slice(F.split("text", "\n"), 2, F.size(F.split("text", "\n")))
    hunks = spread.select(
        "doc", "path", "hunk", F.regexp_extract("text", header, 1).cast("int").alias("new_start"),
        F.when(size == "", 1).otherwise(size.try_cast("int")).alias("new_len"), body.alias("body"))
    starts = lambda mark: F.size(F.filter("body", lambda l: l.startswith(mark)))
    counted = hunks.select("doc", "path", "hunk", "new_start", "new_len", starts("+").alias("added_len"),
                           starts("-").alias("removed_len"))
    lines = hunks.select("doc", "path", "hunk", F.posexplode("body").alias("at", "l")).filter(
        F.col("l").rlike(r"^[+-]")).select("doc", "path", "hunk", "at", F.when(F.col("l").startswith("+"), "added")
                                            .otherwise("removed").alias("side"), F.substring("l", 2, 1 << 30).alias("text"))
    return Changes(counted, lines, named.select("doc", "path", "old_path", "status"), rejected)


def read_change_intervals(spark: SparkSession, glob: str, strip: str | None = None) -> Changes:
    docs = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))
    return explode_patch(docs, strip=strip)


__all__ = ["Changes", "explode_patch", "read_change_intervals"]
