"""Readers of source trees, code graphs, cases and pull-request files; writers of reviews and indexes."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.text import SKIP_DIRS, line_of_location


def source_tree(spark: SparkSession, root: str, suffixes: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``path, text`` of the files under ``root``; skips the usual folders, keeps listed suffixes and, with ``only`` (path), its files.

    Names that begin with ``_`` or a dot count too (Spark's own readers leave
    them out). Only names reach the driver; texts are read where they are used,
    broken UTF-8 replaced, unreadable files left out. ``root`` is a path or URI
    that every executor can read.
    """
    uri = root if "://" in root else os.path.abspath(root)
    fs, base = pafs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    kept = {x.lower().lstrip(".") for x in suffixes} if suffixes else None
    paths = sorted(
        path
        for f in fs.get_file_info(pafs.FileSelector(base, recursive=True))
        if f.type == pafs.FileType.File
        and not set((path := f.path[len(base) + 1 :]).split("/")[:-1]) & set(SKIP_DIRS)
        and (kept is None or f.extension.lower() in kept)
    )

    def read(batches):
        files, home = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    with files.open_input_stream(f"{home.rstrip('/')}/{path}") as f:
                        out.append((path, f.read().decode("utf-8", "replace")))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["path", "text"])

    names = spark.createDataFrame([(p,) for p in paths], "path string")
    names = names.join(only.select("path").distinct(), "path", "left_semi") if only is not None else names
    return names.mapInArrow(read, "path string, text string")


def code_graph(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of node-link JSON documents; edges are called ``links`` or ``edges``, paths lose ``root`` and ``./``."""
    node = "struct<id:string,label:string,kind:string,file_type:string,source_file:string,source_location:string,end_line:int>"
    edge = "struct<source:string,target:string,relation:string,confidence:string,source_file:string,source_location:string,weight:double>"
    doc = spark.read.schema(f"nodes array<{node}>, links array<{edge}>, edges array<{edge}>").option("multiLine", True).json(path)
    prefix = root.rstrip("/") + "/"
    clean = lambda c: F.regexp_replace(F.when(F.col(c).startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(F.col(c)), r"^(\./)+", "")
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    nodes = n.select(F.col("id").alias("node"), "label", F.coalesce("kind", "file_type").alias("kind"), clean("source_file").alias("source_file"), line_of_location(F.col("source_location")).alias("start_line"), "end_line")
    return nodes, e.select("source", "target", "relation", "confidence", clean("source_file").alias("source_file"), line_of_location(F.col("source_location")).alias("line"), "weight")


def seeded_cases(spark: SparkSession, path: str) -> DataFrame:
    """``id, edit_no, file, find, replace`` of case files."""
    doc = spark.read.schema("id string, edits array<struct<file:string,find:string,replace:string>>").option("multiLine", True).json(path)
    return doc.select("id", F.posexplode("edits").alias("edit_no", "e")).select("id", "edit_no", "e.*")


def apply_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``id, file, text`` with each edit's text replaced; an edit whose text is not there exactly once is an error."""
    rows = edits.join(files.select(F.col("path").alias("file"), "text"), "file")
    times = (F.length("text") - F.length(F.replace("text", "find", F.lit("")))) / F.length("find")
    return rows.select("id", "file", F.when(times == 1, F.replace("text", "find", "replace")).otherwise(F.raise_error(F.concat(F.lit("edit of "), "id", F.lit(" matches not exactly once")))).alias("text"))


def anchor_range(text, anchor):
    """Struct ``first, last``: the lines an anchor text covers; NULL where it isn't in the text."""
    at = F.locate(anchor, text) if isinstance(anchor, str) else F.instr(text, anchor)
    first = F.size(F.split(F.substring(text, F.lit(1), at - F.lit(1)), "\n"))
    body = F.lit(anchor.strip("\n")) if isinstance(anchor, str) else F.regexp_replace(anchor, r"^\n+|\n+$", "")
    return F.when(at > 0, F.struct(first.alias("first"), (first + F.size(F.split(body, "\n")) - 1).alias("last")))


class PullRequestFiles(DataSource):
    """Pages of a pull request's files as a batch source: ``spark.read.format("pull_request_files")``.

    Each page is one partition, up to ``max_files``. ``fetch`` names a function
    ``module:function`` taking (repo, number, page, size) and giving dicts, so
    the transport (and its retries) stays outside the engine.
    """

    PAGE = 100

    @classmethod
    def name(cls) -> str:
        return "pull_request_files"

    def schema(self) -> str:
        return "filename string, status string, additions int, deletions int, patch string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.options = dict(options)

    def partitions(self):  # noqa: ANN201
        pages = -(-int(self.options.get("max_files", "300")) // PullRequestFiles.PAGE)
        return [InputPartition(i + 1) for i in range(pages)]

    def read(self, partition):  # noqa: ANN001, ANN201
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        most = int(self.options.get("max_files", "300")) - (partition.value - 1) * PullRequestFiles.PAGE
        for f in fetch(self.options["repo"], int(self.options["number"]), partition.value, PullRequestFiles.PAGE)[:most]:
            yield (f.get("filename"), f.get("status"), f.get("additions"), f.get("deletions"), f.get("patch"))


def decode_content(content):
    """Text of a base64 file content."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "utf-8")


def upsert(index: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``index`` with the rows of all keys in ``new`` replaced by its rows."""
    return index.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_paths(index: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(gone.select(*keys).distinct(), keys, "left_anti")


def head_content(wanted: DataFrame, shipped: DataFrame, looked_up: DataFrame) -> DataFrame:
    """``job_id, path, text``: the text a job brought, else the one looked up by path; paths that climb out have none."""
    own = shipped.select("job_id", F.explode("head_files").alias("path", "own"))
    rows = wanted.join(own, ["job_id", "path"], "left").join(looked_up.select("path", F.col("text").alias("other")), "path", "left")
    climbs = F.array_contains(F.split("path", "/"), "..") | F.col("path").startswith("/")
    return rows.select("job_id", "path", F.when(~climbs, F.coalesce("own", "other")).alias("text"))


def review_markdown(findings: DataFrame) -> DataFrame:
    """``job_id, body``: a review's findings as text, one paragraph each, in order of severity, file and line."""
    mark = F.concat(F.lit("**"), F.upper("severity"), F.lit("** "), "title", F.lit(" ("), F.format_string("%.0f%%", F.col("confidence") * 100), F.lit(")"))
    where = F.concat_ws(":", "file", F.col("line").cast("string"))
    rank = F.array_position(F.array(*[F.lit(s) for s in ("critical", "warning", "info", "nitpick")]), F.col("severity"))
    item = F.struct(rank.alias("rank"), "file", F.coalesce("line", F.lit(0)).alias("line"), "id", F.concat_ws("\n", mark, where, "message", F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("Suggestion: "), "suggestion"))).alias("text"))
    return findings.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select("job_id", F.array_join(F.transform("items", lambda x: x["text"]), "\n\n").alias("body"))


def publish_once(reviews: DataFrame, posted: DataFrame, key: str = "job_id") -> DataFrame:
    """Reviews not posted yet, one per key."""
    return reviews.dropDuplicates([key]).join(posted.select(key).distinct(), key, "left_anti")


