"""Guards and routes of incoming events and requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import bare_path

# Pull-request actions that start a review, and the characters a request's head files may have together.
ACTIONS = ["opened", "synchronize", "reopened", "ready_for_review"]
HEAD_FILES_LIMIT = 4 * 1024 * 1024


def starts_review(action: Column, draft: Column) -> Column:
    """An action that asks for a review of a pull request that is no draft; a missing ``draft`` is none."""
    return F.coalesce(action.isin(ACTIONS), F.lit(False)) & ~F.coalesce(draft, F.lit(False))


def on_default_branch(ref: Column, default: Column) -> Column:
    """A push to the default branch, ``main`` where none is named."""
    return F.coalesce(ref == F.concat(F.lit("refs/heads/"), F.coalesce(F.nullif(default, F.lit("")), F.lit("main"))), F.lit(False))


def expects(expected: Column, agent: Column) -> Column:
    """Whether a request wants ``agent``; an empty or missing list wants every one."""
    return (F.coalesce(F.size(expected), F.lit(0)) <= 0) | F.coalesce(F.array_contains(expected, agent), F.lit(False))


def head_files_fit(head_files: Column, limit: int = HEAD_FILES_LIMIT) -> Column:
    """Whether all texts together stay within ``limit`` characters."""
    return F.aggregate(F.coalesce(F.map_values(head_files), F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))) <= limit


def static_target(path: Column, status: Column) -> Column:
    """A Python file that still exists."""
    return F.coalesce(path.endswith(".py"), F.lit(False)) & (F.coalesce(F.lower(F.trim(status)), F.lit("")) != "removed")


def repository_name(name: Column) -> Column:
    """``owner/name`` of letters, digits, ``_``, ``.`` and ``-``, without two dots in a row."""
    return F.coalesce(name.rlike(r"^[\w.-]+/[\w.-]+$") & ~F.contains(name, F.lit("..")), F.lit(False))


def within(name: Column, allowed: list[str] | None) -> Column:
    """Membership in an allow-list (tools, case ids); without a list everything passes."""
    return F.lit(True) if allowed is None else F.coalesce(name.isin(list(allowed)), F.lit(False))


def head_files_of(head_files: Column, paths: Column) -> Column:
    """The head files whose path is among the changed ones."""
    return F.map_filter(head_files, lambda p, _: F.array_contains(paths, p))


def pushed_paths(commits: Column) -> Column:
    """Distinct paths of all commits (added, modified, removed), sorted; NULL, for all files, where there are none."""
    lists = F.transform(commits, lambda c: F.concat(*[F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed")]))
    paths = F.array_sort(F.array_distinct(F.filter(F.flatten(lists), lambda p: p.isNotNull())))
    return F.when(F.size(paths) > 0, paths)


EVENT = (
    "action string, ref string, after string, repository struct<full_name:string,default_branch:string>, "
    "pull_request struct<number:long,draft:boolean,head:struct<sha:string>>, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
)


def route_events(events: DataFrame) -> DataFrame:
    """``events`` (kind, signed, body) with ``route`` (review, index or ignored), ``repo``, ``sha`` and ``paths``.

    Unsigned events, bodies that are no JSON object and repositories without a
    valid name are ignored.
    """
    e = F.from_json("body", EVENT)
    known = F.coalesce("signed", F.lit(False)) & repository_name(e["repository"]["full_name"])
    review = known & (F.col("kind") == "pull_request") & starts_review(e["action"], e["pull_request"]["draft"])
    index = known & (F.col("kind") == "push") & on_default_branch(e["ref"], e["repository"]["default_branch"])
    route = F.when(F.coalesce(review, F.lit(False)), "review").when(F.coalesce(index, F.lit(False)), "index").otherwise("ignored")
    return events.withColumn("route", route).withColumns(
        {
            "repo": e["repository"]["full_name"],
            "sha": F.when(F.col("route") == "review", e["pull_request"]["head"]["sha"]).when(F.col("route") == "index", e["after"]),
            "paths": F.when(F.col("route") == "index", pushed_paths(e["commits"])),
        }
    )


def added_line_diagnostics(diagnostics: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics (keys, filename, row, code, message) on added lines (keys, file, line), as findings of confidence 0.9.

    A file name may be longer than the changed path, as linters give absolute
    ones: it is the changed file of the longest suffix.
    """
    from siltstone.operators.findings import classify_code

    parts = F.split(bare_path(F.col("filename")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = diagnostics.where("filename is not null and row is not null").withColumn("__row", F.xxhash64(*keys, "filename", "row", "code", "message"))
    at = added.select(*keys, bare_path(F.col("file")).alias("file"), F.col("line").alias("row")).distinct()
    hit = rows.withColumn("file", F.explode(suffixes)).join(at, [*keys, "file", "row"])
    severity, category = classify_code(F.col("d.code"))
    first = hit.groupBy("__row").agg(F.max_by(F.struct(*keys, "file", "row", "code", "message"), F.length("file")).alias("d"))
    return first.select(*[F.col(f"d.{k}") for k in keys], "d.file", F.col("d.row").alias("line"), F.lit("static").alias("agent"), severity.alias("severity"), category.alias("category"), F.concat_ws(": ", "d.code", "d.message").alias("title"), F.lit(0.9).alias("confidence"))
