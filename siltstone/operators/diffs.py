"""Unified diffs as rows of files and of new-side lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import split_lines

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def patch_lines(files: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """``key, pos, hunk, kind, new_line, text`` of the lines of each patch.

    ``kind`` is ``+`` for added, a blank for context (an empty line is one),
    ``-`` for removed. Numbers restart at each hunk header; removed lines and
    remarks take none (NULL). Lines before the first header and hunks that
    start at line 0 have no rows. NULL and empty patches give none.
    """
    rows = files.where(F.length(patch) > 0).select(key, F.posexplode(split_lines(F.col(patch))).alias("pos", "line"))
    start = F.nullif(F.regexp_extract("line", HUNK, 3), F.lit("")).cast("int")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", start).withColumn("hunk", F.count("start").over(so_far).cast("int"))
    sign = F.substring("line", 1, 1)
    kind = F.when(F.col("start").isNotNull(), "@").when(sign.isin("+", "-", "\\"), sign).otherwise(" ")
    takes = F.col("kind").isin("+", " ").cast("int")
    before = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kind", kind).withColumn("first", F.max("start").over(Window.partitionBy(key, "hunk")))
    number = F.col("first") + F.coalesce(F.sum(takes).over(before), F.lit(0))
    return (
        rows.withColumn("new_line", F.when(F.col("kind").isin("+", " "), number).cast("int"))
        .where("hunk > 0 and first > 0 and kind in ('+', ' ', '-')")
        .select(key, "pos", "hunk", "kind", "new_line", F.when(F.col("line") == "", "").otherwise(F.substring("line", 2, 1 << 30)).alias("text"))
    )


def commentable_lines(lines: DataFrame, key: str) -> DataFrame:
    """Arrays of added and of commentable (added or context) new-side lines per patch."""
    added = F.collect_set(F.when(F.col("kind") == "+", F.col("new_line")))
    return lines.where("new_line is not null").groupBy(key).agg(
        F.array_sort(added).alias("added_lines"), F.array_sort(F.collect_set("new_line")).alias("commentable_lines")
    )


def annotate_patch(lines: DataFrame, key: str) -> DataFrame:
    """The patch with a gutter of new-side numbers; removed lines have a blank one."""
    shown = F.format_string("%s %s%s", F.lpad(F.coalesce(F.col("new_line").cast("string"), F.lit("")), 5, " "), "kind", "text")
    ordered = F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n").alias("annotated"))


def split_git_diff(texts: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """``key, file_no, path, old_path, status, additions, deletions, patch`` of each file in a git diff."""
    blocks = F.filter(F.split(F.col(text), r"(?m)^(?=diff --git )"), lambda b: b.startswith("diff --git "))
    rows = texts.select(key, F.posexplode(blocks).alias("file_no", "block"))
    grab = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    head_old, head_new = grab(r"^diff --git a/(.*?) b/"), grab(r"^diff --git a/.*? b/([^\n]*)")
    old, new = grab(r"(?m)^--- ([^\n\t]*)"), grab(r"(?m)^\+\+\+ ([^\n\t]*)")
    side = lambda p, head: F.when(p == "/dev/null", None).when(p.isNotNull(), F.regexp_replace(p, "^[ab]/", "")).otherwise(head)
    old_path, new_path = side(old, head_old), side(new, head_new)
    renamed = grab(r"(?m)^rename from ([^\n]*)")
    status = (
        F.when(new_path.isNull(), "removed").when(old_path.isNull(), "added").when(renamed.isNotNull() | (old_path != new_path), "renamed").otherwise("modified")
    )
    at = F.locate("\n@@ ", F.col("block"))
    patch = F.when(at > 0, F.regexp_replace(F.substring("block", at + F.lit(1), F.lit(1 << 30)), r"\n$", "")).otherwise("")
    count = lambda s: F.size(F.filter(F.split("patch", "\n"), lambda x: x.startswith(s)))
    return (
        rows.select(
            key, "file_no", F.coalesce(new_path, old_path).alias("path"), F.when(status == "renamed", F.coalesce(renamed, old_path)).alias("old_path"), status.alias("status"), patch.alias("patch")
        )
        .withColumn("additions", F.when(F.col("patch") == "", 0).otherwise(count("+")))
        .withColumn("deletions", F.when(F.col("patch") == "", 0).otherwise(count("-")))
    )
