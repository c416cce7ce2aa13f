"""The engine as one object: index, search, impact, review, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import chunks, diffs, evaluation, findings, graph, reports, retrieval
from siltstone.sources.files import source_tree, upsert


@dataclass(frozen=True)
class Settings:
    """Limits of the read operations."""

    search_k: int = 6
    impact_depth: int = 2
    impact_limit: int = 40
    min_confidence: float = 0.6
    report_chars: int = 6000


#: Characters of a tool's answer, and what a longer one ends in.
TOOL_CHARS, CUT = 8000, "\n… truncated"


@dataclass(frozen=True)
class Tool:
    """A named read operation with the JSON schema of its arguments; calls never raise."""

    name: str
    properties: dict[str, dict]
    run: Callable[..., str]

    @property
    def schema(self) -> dict:
        optional = {"depth"}
        return {"type": "object", "properties": self.properties, "required": [p for p in self.properties if p not in optional], "additionalProperties": False}

    def __call__(self, **arguments) -> str:
        unknown, missing = set(arguments) - set(self.properties), set(self.schema["required"]) - set(arguments)
        if unknown or missing:
            return f"error: {self.name} takes {sorted(self.properties)}"
        try:
            out = self.run(**arguments) or ""
        except Exception as e:
            return f"error: {str(e)[:500]}"
        return out if len(out) <= TOOL_CHARS else out[:TOOL_CHARS] + CUT


@dataclass
class Engine:
    """Tables of one indexed repository and the questions asked of them.

    An unknown repository is a LookupError.
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    indexes: dict[str, dict[str, DataFrame]] = field(default_factory=dict)

    def index(self, repo: str, root: str, only: DataFrame | None = None) -> dict[str, DataFrame]:
        """Read a source tree into nodes, edges and chunks; with ``only`` (path) just those files are cut anew."""
        files = source_tree(self.spark, root)
        nodes, edges = graph.python_graph(files.where(F.col("path").endswith(".py")))
        part = files.join(only.select("path").distinct(), "path", "left_semi") if only is not None else files
        cut = chunks.chunk_files(part, "path")
        texts = cut.join(files, "path").withColumn("text", F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
        texts = texts.withColumn("chunk_id", F.xxhash64("path", "start_line", "end_line", "kind"))
        if only is not None and repo in self.indexes:
            old = self.indexes[repo]["chunks"].join(only.select("path").distinct(), "path", "left_anti")
            texts = upsert(old, texts, ["path"])
        self.indexes[repo] = {"files": files, "nodes": nodes, "edges": edges, "chunks": texts}
        return self.indexes[repo]

    def _of(self, repo: str) -> dict[str, DataFrame]:
        if repo not in self.indexes:
            raise LookupError(f"repository {repo} is not indexed")
        return self.indexes[repo]

    def stats(self, repo: str) -> DataFrame:
        i = self._of(repo)
        return graph.graph_stats(i["nodes"], i["edges"])

    def find(self, repo: str, symbol: str, limit: int = 5) -> DataFrame:
        """Nodes by id, else by label, else by the last part of the label."""
        n = self._of(repo)["nodes"]
        tier = F.when(F.col("node") == symbol, 1).when(F.col("label") == symbol, 2).when(F.element_at(F.split("label", r"\."), -1) == symbol, 3)
        rows = n.withColumn("tier", tier).where("tier is not null")
        top = rows.agg(F.min("tier").alias("tier"))
        return rows.join(F.broadcast(top), "tier").drop("tier").orderBy("node").limit(limit)

    def impact(self, repo: str, changed: DataFrame, depth: int | None = None) -> DataFrame:
        """Dependents of the symbols around changed lines (path, patch)."""
        i = self._of(repo)
        lines = diffs.patch_lines(changed, "path").where("kind = '+'").select("path", F.col("new_line").alias("line"))
        bare = changed.select("path").distinct().join(lines.select("path").distinct(), "path", "left_anti").withColumn("line", F.lit(1))
        syms = i["nodes"].where("kind <> 'file'").select(F.col("source_file").alias("path"), F.col("node").alias("symbol"), "start_line", "end_line")
        hit = graph.enclosing_symbols(lines.unionByName(bare), syms, ["path"])
        seeds = hit.select(F.coalesce("symbol", "path").alias("node")).distinct()
        return graph.impact(i["edges"], seeds, depth or self.settings.impact_depth, self.settings.impact_limit, graph.DEPENDENCY_RELATIONS)

    def _seeds(self, repo: str, changed: DataFrame) -> DataFrame:
        """``path, node`` around the added lines of changed files (path, patch); ``node`` is NULL for a file not in the graph."""
        i = self._of(repo)
        lines = diffs.patch_lines(changed, "path").where("kind = '+'").select("path", F.col("new_line").alias("line"))
        bare = changed.select("path").distinct().join(lines.select("path").distinct(), "path", "left_anti").withColumn("line", F.lit(1))
        syms = i["nodes"].where("kind <> 'file'").select(F.col("source_file").alias("path"), F.col("node").alias("symbol"), "start_line", "end_line")
        hit = graph.enclosing_symbols(lines.unionByName(bare), syms, ["path"])
        files = i["nodes"].where("kind = 'file'").select(F.col("source_file").alias("path"), F.col("node").alias("file_node"))
        return hit.join(files, "path", "left").select("path", F.coalesce("symbol", "file_node").alias("node")).distinct()

    def impact_report(self, repo: str, changed: DataFrame, depth: int = 2, budget: int | None = None) -> str:
        """Changed symbols, dependents within half the budget, and at most 15 tests that reach the change."""
        budget = budget or self.settings.report_chars
        i, seeds = self._of(repo), self._seeds(repo, changed)
        about = reports.describe_nodes(i["nodes"]).select("node", "about")
        found = seeds.join(about, "node", "left").select("path", F.when(F.col("node").isNull(), F.concat(F.lit("  "), "path", F.lit(": not in graph (new file or not indexed)"))).otherwise(F.concat(F.lit("  "), "about")).alias("line"))
        numbered = lambda d, by: d.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)).alias("pos"), "line")
        text = lambda d: reports.joined(d).first()["report"]
        nodes = seeds.select("node").where("node is not null").distinct()
        hits = graph.impact(i["edges"], nodes, depth, self.settings.impact_limit, graph.DEPENDENCY_RELATIONS)
        title = f"DEPENDENTS (reverse deps, ≤{depth} hops) — code that may break:"
        tests = graph.reaching_tests(i["edges"], i["nodes"], nodes).join(about, "node").orderBy("distance", "node").limit(15).select("node", F.concat(F.lit("  "), "about").alias("line"))
        parts = [
            "CHANGED SYMBOLS (graph nodes enclosing the edited lines):", text(numbered(found, ["path", "line"])),
            text(reports.cut_lines(reports.hit_lines(hits, i["nodes"]), budget // 2, title=title)),
            "TESTS REACHING THE CHANGE:", text(numbered(tests, ["node"])) or "  (none — changed code appears untested)",
        ]
        return "\n".join(p for p in parts if p)[:budget]

    def pack_context(self, repo: str, changed: DataFrame, budget: int = 12_000) -> str:
        """The impact report in a third of the budget, then snippets of up to 8 dependents outside the changed files while they fit."""
        i = self._of(repo)
        parts = [self.impact_report(repo, changed, budget=budget // 3)]
        nodes = self._seeds(repo, changed).select("node").where("node is not null").distinct()
        near = graph.impact(i["edges"], nodes, 1, 8, graph.DEPENDENCY_RELATIONS)
        outside = near.join(reports.describe_nodes(i["nodes"]), "node").join(changed.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti").where("start_line is not null")
        used = len(parts[0])
        for r in outside.orderBy("distance", F.desc("in_degree"), "node").collect():  # eight at most
            lines = self.read_snippet(repo, r.source_file, r.start_line, min(r.end_line or r.start_line + 30, r.start_line + 40)).collect()
            block = f"--- dependent: {r.about}\n" + "\n".join(f"{x.line_no:>5}  {x.line}".rstrip() for x in lines)
            if used + len(block) > budget:
                break
            parts.append(block)
            used += len(block)
        return "\n\n".join(parts)

    def callers_report(self, repo: str, symbol: str, depth: int = 1) -> str:
        """Callers in 2,500 characters and callees in 1,200 for each node of that name, of which there are few."""
        i = self._of(repo)
        named = self.find(repo, symbol).join(reports.describe_nodes(i["nodes"]).select("node", "about"), "node").orderBy("node").collect()
        if not named:
            return f"No symbol named {symbol!r} in the graph."
        out = []
        for r in named:
            seed = i["nodes"].where(F.col("node") == r.node).select("node")
            up = graph.traverse(i["edges"], seed, min(max(depth, 1), 3), reverse=True, relations=graph.CALL_RELATIONS, limit=25)
            for title, hits, room in ((f"Callers of {r.about}:", up, 2500), (f"Callees of {r.about}:", graph.callees(i["edges"], seed), 1200)):
                out.append(reports.joined(reports.cut_lines(reports.hit_lines(hits, i["nodes"]), room, title=title)).first()["report"])
        return "\n".join(out)

    def tests_report(self, repo: str, symbol: str) -> str:
        """At most 20 tests that reach a symbol within three steps."""
        i = self._of(repo)
        if self.find(repo, symbol).isEmpty():
            return f"No symbol named {symbol!r} in the graph."
        about = reports.describe_nodes(i["nodes"]).select("node", "about")
        rows = self.find_tests(repo, symbol).join(about, "node").orderBy("distance", "node").limit(20).collect()
        return "\n".join(f"  {r.about}" for r in rows) or f"No tests reach {symbol} within 3 hops."

    def search_report(self, repo: str, text: str, kind: str | None = "code", k: int | None = None, exclude: list[str] | None = None) -> str:
        """Search results with numbered lines, 40 of code and 30 of documents each."""
        most = 40 if kind == "code" else 30
        hits = self.search(repo, text, kind, k, exclude)
        rows = hits.join(self._of(repo)["chunks"].withColumnRenamed("chunk_id", "item"), "item").orderBy("rank").collect()  # k at most
        out = []
        for r in rows:
            body = "\n".join(f"{r.start_line + n:>5}  {line}" for n, line in enumerate(r.text.split("\n")[:most]))
            out.append(f"--- {r.path}:{r.start_line}-{r.end_line}{f' ({r.symbol})' if r.symbol else ''} score={round(r.score, 4)}\n{body}")
        return "\n".join(out) or ("No matches." if kind == "code" else "No repository docs/guidelines indexed.")

    def impact_for_range(self, repo: str, path: str, start: int, end: int) -> DataFrame:
        patch = f"@@ -{start},0 +{start},{end - start + 1} @@\n" + "\n".join("+" for _ in range(end - start + 1))
        return self.impact(repo, self.spark.createDataFrame([(path, patch)], "path string, patch string"))

    def count_chunks(self, repo: str) -> int:
        return self._of(repo)["chunks"].count()

    def tools(self, repo: str, allowed: list[str] | None = None) -> dict[str, Tool]:
        """What an agent may call on an indexed repository, by name, with the schema of its arguments; ``allowed`` restricts it."""
        self._of(repo)
        text, number = {"type": "string"}, {"type": "integer"}
        every = [
            Tool("get_impact", {"path": text, "start": number, "end": number}, lambda path, start, end: reports.joined(reports.hit_lines(self.impact_for_range(repo, path, start, end), self._of(repo)["nodes"])).first()["report"]),
            Tool("get_callers", {"symbol": text, "depth": number}, lambda symbol, depth=1: self.callers_report(repo, symbol, depth)),
            Tool("find_tests", {"symbol": text}, lambda symbol: self.tests_report(repo, symbol)),
            Tool("search_code", {"query": text}, lambda query: self.search_report(repo, query, "code", 5)),
            Tool("search_docs", {"query": text}, lambda query: self.search_report(repo, query, "doc", 4)),
            Tool("read_snippet", {"path": text, "start": number, "end": number}, lambda path, start, end: "\n".join(f"{r.line_no:>5}  {r.line}" for r in self.read_snippet(repo, path, start, min(end, start + 200)).collect())),
        ]
        return {t.name: t for t in every if allowed is None or t.name in allowed}

    def callers(self, repo: str, symbol: str) -> DataFrame:
        return graph.callers(self._of(repo)["edges"], self.find(repo, symbol).select("node"))

    def callees(self, repo: str, symbol: str) -> DataFrame:
        return graph.callees(self._of(repo)["edges"], self.find(repo, symbol).select("node"))

    def find_tests(self, repo: str, symbol: str) -> DataFrame:
        i = self._of(repo)
        return graph.reaching_tests(i["edges"], i["nodes"], self.find(repo, symbol).select("node"))

    def read_snippet(self, repo: str, path: str, start: int, end: int) -> DataFrame:
        c = self._of(repo)["chunks"].where(F.col("path") == path)
        return chunks.rebuild_snippet(c, ["path"], start, end).orderBy("line_no")

    def search(self, repo: str, text: str, kind: str | None = None, k: int | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Chunks by dense and sparse search, fused; ``item`` is the chunk_id. ``kind`` and excluded paths filter before the search."""
        rows = self._of(repo)["chunks"]
        rows = rows.where(F.col("kind") == kind) if kind else rows
        rows = rows.where(~F.col("path").isin(list(exclude))) if exclude else rows
        rows = rows.select(F.col("chunk_id").alias("item"), F.concat_ws("\n", F.concat_ws(" :: ", "path", "symbol"), "text").alias("text"))
        asked = self.spark.createDataFrame([(0, text)], "query long, text string")
        return retrieval.hybrid_search(asked, rows, k or self.settings.search_k)

    def review(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(findings, verdicts)`` of changed files (job_id, path, patch) by the rules and the stand-in judge."""
        f = files.withColumn("key", F.concat_ws("|", "job_id", "path"))
        lines = diffs.patch_lines(f, "key").where("kind = '+'").join(f.select("key", "job_id", F.col("path").alias("file")), "key")
        found = findings.scan_rules(lines, ["job_id"]).withColumns(
            {"id": F.substring(F.md5(F.concat_ws("|", "job_id", "file", "line", "title")), 1, 10), "repo": F.lit(None).cast("string"), "end_line": F.col("line"), "suggestion": F.lit(None).cast("string"), "evidence": F.array("evidence"), "reported_by": F.array("agent")}
        )
        merged = findings.greedy_clusters(findings.sanitize(found)).withColumn("agent", F.element_at("reported_by", 1))
        judged = findings.apply_judgments(merged, merged.select("id", F.lit(1).alias("ordinal"), F.lit(True).alias("keep"), F.lit(0.8).alias("confidence"), "severity", F.lit("rule match").alias("reason")), self.settings.min_confidence)
        return merged, findings.verdicts(judged)

    def evaluate(self, found: DataFrame, expected: DataFrame, case: str = "case") -> DataFrame:
        return evaluation.summarize(evaluation.score_cases(found, expected, case))
