"""Code graphs: nodes and edges as tables, questions as joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import absolute_import, bare_path, is_test_path, module_name
from siltstone.session import stage

# Relations a call goes along, and those a dependency goes along.
CALL_RELATIONS = ["calls", "indirect_call", "references", "uses", "uses_static_prop", "references_constant", "bound_to", "listened_by"]
DEPENDENCY_RELATIONS = CALL_RELATIONS + ["imports", "imports_from", "inherits", "extends", "implements", "re_exports"]


def traverse(
    edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, relations: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """``node, distance, relation, via``: what is within ``depth`` steps of ``seeds`` (node), the seeds left out.

    The first discovery counts; among equal ones the smallest ``via``, then
    relation. ``limit`` keeps the first by distance, via, node. One join and
    one combining aggregate per step; seeds that no edge touches find nothing.
    """
    src, dst = ("target", "source") if reverse else ("source", "target")
    steps = edges.where(F.col("relation").isin(relations)) if relations else edges
    steps = steps.where("source is not null and target is not null").select(
        F.col(src).alias("via"), F.col(dst).alias("node"), "relation"
    )
    seen = seeds.select("node").where("node is not null").distinct()
    seen = seen.select("node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast(dict(seen.dtypes)["node"]).alias("via"))
    frontier = seen
    for d in range(1, depth + 1):
        found = (
            frontier.select(F.col("node").alias("via"))
            .join(steps, "via")
            .groupBy("node")
            .agg(F.min(F.struct("via", "relation")).alias("first"))
            .join(seen.select("node"), "node", "left_anti")
            .select("node", F.lit(d).alias("distance"), "first.relation", "first.via")
        )
        if d < depth:  # else each step would compute all before it again
            found = stage(found, "frontier")
        seen, frontier = seen.unionByName(found), found
    out = seen.where("distance > 0")
    return out.orderBy("distance", "via", "node").limit(limit) if limit else out


def in_degree(edges: DataFrame) -> DataFrame:
    """``node, in_degree`` over all relations, parallel edges counted."""
    return edges.where("target is not null").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = 40, relations: list[str] | None = None) -> DataFrame:
    """Everything that depends on ``seeds``, nearest first, then what most depend on."""
    hits = traverse(edges, seeds, depth, reverse=True, relations=relations, limit=limit)
    ranked = hits.join(in_degree(edges), "node", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return ranked.orderBy("distance", F.desc("in_degree"), "node")


def callers(edges: DataFrame, seeds: DataFrame, limit: int | None = 25) -> DataFrame:
    return traverse(edges, seeds, 1, reverse=True, relations=CALL_RELATIONS, limit=limit)


def callees(edges: DataFrame, seeds: DataFrame, limit: int | None = 25) -> DataFrame:
    return traverse(edges, seeds, 1, relations=CALL_RELATIONS, limit=limit)


def reaching_tests(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 3, limit: int | None = 200) -> DataFrame:
    """Dependents within ``depth`` whose file is a test's; ``nodes`` has node and source_file."""
    hits = traverse(edges, seeds, depth, reverse=True, relations=DEPENDENCY_RELATIONS, limit=limit)
    return hits.join(nodes.select("node", "source_file"), "node").where(is_test_path(F.col("source_file")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``measure, n``: nodes, edges, files, and edges per relation."""
    counts = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("source_file").alias("files"))
    long = counts.select(F.expr("stack(2, 'nodes', nodes, 'files', files) as (measure, n)"))
    per = edges.groupBy(F.concat(F.lit("relation:"), "relation").alias("measure")).agg(F.count("*").alias("n"))
    return long.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("measure"), "n")).unionByName(per)


def enclosing_symbols(lines: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line, symbol`` of the innermost symbol around each line.

    ``symbols`` has keys, symbol, start_line and end_line (NULL: open). Among
    those around a line the last to start counts, then the greatest symbol. A
    file none of whose lines resolves gets one row with line and symbol NULL.
    """
    asked = lines.select(*keys, "line").distinct()
    around = (F.col("start_line") <= F.col("line")) & (F.col("end_line").isNull() | (F.col("end_line") >= F.col("line")))
    hit = (
        asked.join(symbols.select(*keys, "symbol", "start_line", "end_line"), keys)
        .where(around)
        .groupBy(*keys, "line")
        .agg(F.max_by("symbol", F.struct("start_line", "symbol")).alias("symbol"))
    )
    bare = asked.select(*keys).distinct().join(hit.select(*keys), keys, "left_anti")
    return hit.unionByName(bare.select(*keys, F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("symbol")))


def resolve_paths(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``path, resolved``: the known path that is the asked one, else the only one of which either ends in the other.

    Both sides carry every suffix of their folders, so the search is an equi
    join on suffixes rather than a comparison of all pairs.
    """
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    a = asked.select("path", bare_path(F.col("path")).alias("bare")).where("path is not null").distinct()
    k = known.select(bare_path(F.col("path")).alias("known")).where("known is not null").distinct()
    exact = a.join(k, F.col("bare") == F.col("known")).select("path", F.col("known").alias("resolved"))
    rest = a.join(exact, "path", "left_anti")
    longer = rest.join(k.select("known", F.explode(suffixes(F.col("known"))).alias("bare")), "bare").select("path", "known")
    shorter = rest.select("path", F.explode(suffixes(F.col("bare"))).alias("known")).join(k, "known")
    fits = longer.unionByName(shorter.select("path", "known")).distinct().groupBy("path").agg(F.count("*").alias("n"), F.min("known").alias("known"))
    loose = rest.select("path").join(fits.where("n = 1"), "path", "left").select("path", F.col("known").alias("resolved"))
    return exact.unionByName(loose)


def longest_prefix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """``name, module``: the longest dotted prefix of each name that is a module."""
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda i: F.array_join(F.slice(F.split("name", r"\."), F.lit(1), i), ".")
    )
    rows = names.select("name").where("name is not null").distinct().select("name", F.explode(prefixes).alias("module"))
    return rows.join(modules.select("module").distinct(), "module").groupBy("name").agg(F.max_by("module", F.length("module")).alias("module"))


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """``caller, target, confidence, line`` of calls (caller, file, owner, name, on_self, line).

    A name is looked for among imported symbols (imports: file, name, from_file,
    and ``real``, the name there, where it differs),
    on self in the caller's class, in the caller's file, and at last anywhere if
    at most three definitions (node, file, owner, name) have it; then all of
    them count, INFERRED where there are several. One edge per caller and
    target, none to itself.
    """
    c = calls.withColumn("call", F.xxhash64("caller", "file", "name", "line", "on_self"))
    d = definitions.select(F.col("node").alias("target"), "file", "owner", "name")
    free = d.where("owner is null").drop("owner")
    named = imports.select("file", "name", F.col("from_file"), F.col("real") if "real" in imports.columns else F.col("name").alias("real")).distinct()
    direct = c.join(named, ["file", "name"]).join(free.withColumnsRenamed({"file": "from_file", "name": "real"}), ["from_file", "real"]).select("call", "caller", "line", "target", F.lit(1).alias("tier"))
    own = c.where("on_self").join(d, ["file", "owner", "name"]).select("call", "caller", "line", "target", F.lit(2).alias("tier"))
    local = c.where("not on_self").join(free, ["file", "name"]).select("call", "caller", "line", "target", F.lit(3).alias("tier"))
    few = d.groupBy("name").agg(F.count("*").alias("n")).where("n <= 3")
    d = d.select("name", "target")
    anywhere = c.join(few, "name").join(d, "name").select("call", "caller", "line", "target", F.lit(4).alias("tier"), "n")
    tiers = direct.unionByName(own).unionByName(local).groupBy("call", "caller", "line", "tier").agg(F.min("target").alias("target")).withColumn("n", F.lit(1).cast("long"))
    ranked = tiers.unionByName(anywhere).withColumn("best", F.min("tier").over(Window.partitionBy("call"))).where("tier = best")
    return (
        ranked.where("caller <> target")
        .groupBy("caller", "target")
        .agg(F.min(F.struct("tier", "n", "line")).alias("first"))
        .select("caller", "target", F.when(F.col("first.n") > 1, "INFERRED").otherwise("EXTRACTED").alias("confidence"), F.col("first.line").alias("line"))
    )


def python_facts(files: DataFrame) -> DataFrame:
    """``path, fact, node, owner, name, line, end_line, extra`` of Python files (path, text): definitions, calls, bases and imports."""

    def facts(path: str, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out: list[tuple] = [(path, "file", path, None, path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, None)]

        def walk(body: list, scope: str, owner: str | None) -> None:
            for x in body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    node = f"{path}::{owner + '.' if owner else ''}{x.name}"
                    kind = "class" if isinstance(x, ast.ClassDef) else "method" if owner else "function"
                    out.append((path, kind, node, owner, x.name, x.lineno, x.end_lineno, scope))
                    if isinstance(x, ast.ClassDef):
                        out.extend((path, "base", node, None, ast.unparse(b), x.lineno, None, None) for b in x.bases)
                    walk(x.body, node, x.name if isinstance(x, ast.ClassDef) else owner)
                    continue
                for y in ast.walk(x):
                    if isinstance(y, ast.Call):
                        f = y.func
                        if isinstance(f, ast.Name):
                            out.append((path, "call", scope, owner, f.id, y.lineno, None, None))
                        elif isinstance(f, ast.Attribute):
                            on_self = isinstance(f.value, ast.Name) and f.value.id in ("self", "cls")
                            out.append((path, "call", scope, owner, f.attr, y.lineno, None, "self" if on_self else "attribute"))
                    elif isinstance(y, ast.Import):
                        out.extend((path, "import", scope, None, a.name, y.lineno, None, None) for a in y.names)
                    elif isinstance(y, ast.ImportFrom):
                        out.extend((path, "import_from", scope, a.asname or a.name, a.name, y.lineno, None, "." * y.level + (y.module or "")) for a in y.names)

        walk(tree.body, path, None)
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "fact", "node", "owner", "name", "line", "end_line", "extra"]
        for pdf in batches:
            rows = [r for p, t in zip(pdf.path, pdf.text) for r in facts(p, t.removeprefix("\ufeff"))]
            yield pd.DataFrame(rows, columns=cols).astype({"line": "Int32", "end_line": "Int32"})

    schema = "path string, fact string, node string, owner string, name string, line int, end_line int, extra string"
    return files.where("path is not null and length(text) > 0").select("path", "text").mapInPandas(work, schema)


def python_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of Python files (path, text): contains, imports, calls and inherits."""
    facts = stage(python_facts(files), "facts")
    kinds = ["file", "class", "function", "method"]
    nodes = facts.where(F.col("fact").isin(kinds)).select("node", F.col("name").alias("label"), F.col("fact").alias("kind"), F.col("path").alias("source_file"), F.col("line").alias("start_line"), "end_line").dropDuplicates(["node"])
    edge = lambda d, s, t, r, c="EXTRACTED": d.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(r).alias("relation"), F.lit(c).alias("confidence"), F.col("line"))
    contains = edge(facts.where(F.col("fact").isin(kinds[1:])), "extra", "node", "contains")
    modules = facts.where("fact = 'file'").select(module_name(F.col("path")).alias("module"), F.col("path").alias("target"))
    named = facts.where("fact in ('import', 'import_from')").withColumn(
        "full", F.when(F.col("fact") == "import", F.col("name")).otherwise(F.concat_ws(".", F.nullif(absolute_import(F.col("path"), F.col("extra")), F.lit("")), "name"))
    )
    prefix = longest_prefix(named.select(F.col("full").alias("name")), modules).withColumnRenamed("name", "full")
    imported = named.join(prefix, "full").join(modules, "module").where("path <> target")
    imports = edge(imported.groupBy("path", "target").agg(F.min("line").alias("line")), "path", "target", "imports")
    definitions = facts.where("fact in ('class', 'function', 'method')").select("node", F.col("path").alias("file"), "owner", "name")
    by_name = imported.where("fact = 'import_from'").select(F.col("path").alias("file"), F.col("owner").alias("name"), F.col("name").alias("real"), F.col("target").alias("from_file")).distinct()
    calls = facts.where("fact = 'call'").select(
        F.col("node").alias("caller"), F.col("path").alias("file"), "owner", "name", (F.coalesce("extra", F.lit("")) == "self").alias("on_self"), "line"
    )
    called = resolve_calls(calls, definitions, by_name).select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), "confidence", "line")
    bases = facts.where("fact = 'base'").select(F.col("node").alias("caller"), F.col("path").alias("file"), F.lit(None).cast("string").alias("owner"), F.element_at(F.split("name", r"\."), -1).alias("name"), F.lit(False).alias("on_self"), "line")
    inherits = resolve_calls(bases, definitions, by_name).select(F.col("caller").alias("source"), "target", F.lit("inherits").alias("relation"), "confidence", "line")
    return nodes, contains.unionByName(imports).unionByName(called).unionByName(inherits)
