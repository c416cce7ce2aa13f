"""Stored state: versioned graphs, keyed tables with expiry, evaluation reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class GraphStore:
    """Graphs as Parquet under ``root``, a folder per repository and version.

    The version counts up; the newest is read. Nothing is replaced, so readers
    of an older one are not disturbed and a failed write is never seen: a
    version exists once its ``done`` marker does.
    """

    spark: SparkSession
    root: str

    def _folder(self, repo: str) -> str:
        return f"{self.root.rstrip('/')}/repo={repo.replace('%', '%25').replace('/', '%2F')}"

    def versions(self, repo: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder(repo))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [x.getPath() for x in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "done")))

    def put(self, repo: str, nodes: DataFrame, edges: DataFrame) -> int:
        """Store a graph as the next version of ``repo``."""
        version = (self.versions(repo) or [0])[-1] + 1
        folder = f"{self._folder(repo)}/version={version}"
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        edges.write.mode("overwrite").parquet(f"{folder}/edges")
        self.spark.range(1).write.mode("overwrite").parquet(f"{folder}/done")
        return version

    def get(self, repo: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """``(nodes, edges)`` of the newest or the given version; LookupError where there is none."""
        known = self.versions(repo)
        if not known or (version is not None and version not in known):
            raise LookupError(f"repository {repo} is not indexed")
        folder = f"{self._folder(repo)}/version={version or known[-1]}"
        return self.spark.read.parquet(f"{folder}/nodes"), self.spark.read.parquet(f"{folder}/edges")


def live_state(log: DataFrame, now) -> DataFrame:
    """``key, value`` of a log (key, value, at, ttl): the last write of each key that has not expired at ``now``.

    ``ttl`` is in seconds, NULL never expires; a NULL value deletes. Of writes
    of one moment the greatest value counts.
    """
    last = log.where("key is not null").groupBy("key").agg(F.max_by(F.struct("value", "at", "ttl"), F.struct("at", "value")).alias("w"))
    alive = F.col("w.ttl").isNull() | (F.unix_micros(F.col("w.at").cast("timestamp")) + F.col("w.ttl") * 1_000_000 > F.unix_micros(F.lit(now).cast("timestamp")))
    return last.where(alive & F.col("w.value").isNotNull()).select("key", "w.value")


def due_members(scored: DataFrame, now: float, limit: int | None = None) -> DataFrame:
    """Members (member, score) whose score is at most ``now``, ascending."""
    rows = scored.where(F.col("score") <= now).orderBy("score", "member")
    return rows.limit(limit) if limit else rows


def committed_offsets(acks: DataFrame) -> DataFrame:
    """``group, topic, partition, next``: one past the greatest acknowledged offset."""
    return acks.where("offset is not null").groupBy("group", "topic", "partition").agg((F.max("offset") + 1).alias("next"))


def write_evaluation(summary: DataFrame, path: str) -> DataFrame:
    """Write a summary as JSON and return it as one Markdown table."""
    summary.write.mode("overwrite").json(path)
    names = summary.columns
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    head = "| " + " | ".join(names) + " |\n|" + " --- |" * len(names)
    return summary.select(row.alias("line")).groupBy().agg(F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("markdown"))
