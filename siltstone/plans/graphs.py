"""Graph queries: the foreign-key graph of the star schema, and symbols of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import is_test_path
from siltstone.operators import graph
from siltstone.operators.diffs import patch_lines
from siltstone.sources.tables import table


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Child to parent edges of nation, customer, orders and lineitem."""
    t = lambda n: table(spark, d, n)
    pairs = [
        (t("nation"), "n", "n_nationkey", "r", "n_regionkey", "imports"),
        (t("customer"), "c", "c_custkey", "n", "c_nationkey", "calls"),
        (t("orders"), "o", "o_orderkey", "c", "o_custkey", "calls"),
        (t("lineitem"), "l", F.concat_ws("-", "l_orderkey", "l_linenumber"), "o", "l_orderkey", "uses"),
    ]
    out = None
    for df, a, child, b, parent, relation in pairs:
        source = F.concat(F.lit(a), (F.col(child) if isinstance(child, str) else child).cast("string"))
        e = df.select(source.alias("source"), F.concat(F.lit(b), F.col(parent).cast("string")).alias("target"), F.lit(relation).alias("relation"))
        out = e if out is None else out.unionByName(e)
    return out


def _seed(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


_EDGES = """
edges AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'imports' AS relation FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'calls' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, 'uses' FROM lineitem)"""


def _walk(seed: str, depth: int, reverse: bool = True, where: str = "TRUE") -> str:
    src, dst = ("target", "source") if reverse else ("source", "target")
    return f"""WITH RECURSIVE {_EDGES},
walk AS (
  SELECT '{seed}' AS node, 0 AS distance, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS VARCHAR) AS via
  UNION
  SELECT e.{dst}, w.distance + 1, e.relation, e.{src} FROM walk w JOIN edges e ON e.{src} = w.node AND {where} WHERE w.distance < {depth}),
best AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, via, relation) AS rn FROM walk) WHERE rn = 1 AND distance > 0)
"""


def impact_fk_graph(spark, d):
    return graph.impact(fk_edges(spark, d), _seed(spark, "r1"), depth=2, limit=None)


def impact_limited(spark, d):
    return graph.impact(fk_edges(spark, d), _seed(spark, "r1"), depth=3, limit=40)


def callers_depth1(spark, d):
    return graph.callers(fk_edges(spark, d), _seed(spark, "c7"), limit=None)


def callees_forward(spark, d):
    return graph.callees(fk_edges(spark, d), _seed(spark, "o7"), limit=None)


def graph_in_degree(spark, d):
    return graph.in_degree(fk_edges(spark, d))


def graph_relation_stats(spark, d):
    e = fk_edges(spark, d)
    nodes = e.select(F.col("source").alias("node"), F.substring("source", 1, 1).alias("source_file")).distinct()
    return graph.graph_stats(nodes, e)


def enclosing_symbol(spark, d):
    """Innermost chunk symbol around every added line of a change."""
    lines = patch_lines(table(spark, d, "changed_files"), "change_id").where("kind = '+'")
    files = table(spark, d, "changed_files").select("change_id", "repo", F.regexp_replace("path", r"^(\./)+", "").alias("path"))
    asked = lines.join(files, "change_id").select("repo", "path", F.col("new_line").alias("line"))
    syms = table(spark, d, "chunks").where("symbol is not null and start_line is not null").select("repo", F.regexp_replace("path", r"^(\./)+", "").alias("path"), "symbol", "start_line", "end_line")
    return graph.enclosing_symbols(asked, syms.distinct(), ["repo", "path"])


def path_resolution(spark, d):
    """Files of findings against files of documents, however either spells its folders."""
    asked = table(spark, d, "findings").select(F.col("file").alias("path"))
    return graph.resolve_paths(asked, table(spark, d, "documents").select("path"))


def longest_prefix_module(spark, d):
    docs = table(spark, d, "documents").where("lang = 'python'").select(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("name"))
    return graph.longest_prefix(docs, docs.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("module")))


def reaching_tests_filter(spark, d):
    return table(spark, d, "documents").where(is_test_path(F.col("path"))).select("doc_id", "path")


def python_graph_edges(spark, d):
    """Code graph of the Python files of the corpus, latest text per file."""
    docs = table(spark, d, "documents").where("lang = 'python' and text is not null")
    latest = docs.groupBy("repo", "path").agg(F.max_by("text", F.struct("fetched_at", "doc_id")).alias("text"))
    files = latest.select(F.concat_ws("/", "repo", "path").alias("path"), "text")
    return graph.python_graph(files)[1]


_BARE = r"regexp_replace({}, '^(\./)+', '')"
_LINES = r"""
raw AS (
  SELECT change_id, i - 1 AS pos, l[i] AS line FROM (
    SELECT change_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT change_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS l FROM (
        SELECT change_id, string_split_regex(patch, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS s FROM changed_files WHERE length(patch) > 0)))),
hd AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3), '') AS INT) AS start FROM raw),
hk AS (SELECT *, count(start) OVER (PARTITION BY change_id ORDER BY pos) AS hunk,
  CASE WHEN start IS NOT NULL THEN '@' WHEN line[1] IN ('+', '-', '\') THEN line[1] ELSE ' ' END AS kind FROM hd),
nb AS (SELECT *, max(start) OVER (PARTITION BY change_id, hunk) AS first,
  coalesce(sum(CASE WHEN kind IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM hk),
dl AS (SELECT change_id, pos, hunk, kind, CASE WHEN kind IN ('+', ' ') THEN first + taken END AS new_line, line[2:] AS text
  FROM nb WHERE hunk > 0 AND first > 0 AND kind IN ('+', ' ', '-'))"""

QUERIES = {
    "impact_fk_graph": impact_fk_graph, "impact_limited": impact_limited, "callers_depth1": callers_depth1, "callees_forward": callees_forward, "graph_in_degree": graph_in_degree,
    "graph_relation_stats": graph_relation_stats, "enclosing_symbol": enclosing_symbol, "path_resolution": path_resolution, "longest_prefix_module": longest_prefix_module,
    "reaching_tests_filter": reaching_tests_filter, "python_graph_edges": python_graph_edges,
}
_RANKED = "SELECT b.node, b.distance, b.relation, b.via, count(e.target) AS in_degree FROM best b LEFT JOIN edges e ON e.target = b.node GROUP BY ALL"
ORACLES = {
    "impact_fk_graph": _walk("r1", 2) + _RANKED,
    "impact_limited": _walk("r1", 3).replace("\nbest AS (", "\nall_best AS (") + ", best AS (SELECT * FROM all_best ORDER BY distance, via, node LIMIT 40) " + _RANKED,
    "callers_depth1": _walk("c7", 1, where="e.relation IN ('calls', 'uses')") + "SELECT node, distance, relation, via FROM best",
    "callees_forward": _walk("o7", 1, False, "e.relation IN ('calls', 'uses')") + "SELECT node, distance, relation, via FROM best",
    "graph_in_degree": f"WITH {_EDGES} SELECT target AS node, count(*) AS in_degree FROM edges GROUP BY 1",
    "graph_relation_stats": f"""WITH {_EDGES}
SELECT 'nodes' AS measure, count(DISTINCT source) AS n FROM edges UNION ALL SELECT 'files', count(DISTINCT source[1]) FROM edges
UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'relation:' || relation, count(*) FROM edges GROUP BY 1""",
    "enclosing_symbol": f"""WITH {_LINES},
asked AS (SELECT DISTINCT f.repo, {_BARE.format('f.path')} AS path, dl.new_line AS line FROM dl JOIN changed_files f USING (change_id) WHERE dl.kind = '+'),
syms AS (SELECT DISTINCT repo, {_BARE.format('path')} AS path, symbol, start_line, end_line FROM chunks WHERE symbol IS NOT NULL AND start_line IS NOT NULL),
hit AS (SELECT * EXCLUDE rn FROM (
  SELECT a.repo, a.path, a.line, s.symbol, row_number() OVER (PARTITION BY a.repo, a.path, a.line ORDER BY s.start_line DESC, s.symbol DESC) AS rn
  FROM asked a JOIN syms s ON a.repo = s.repo AND a.path = s.path AND s.start_line <= a.line AND (s.end_line IS NULL OR s.end_line >= a.line)) WHERE rn = 1)
SELECT * FROM hit UNION ALL
SELECT DISTINCT repo, path, NULL, NULL FROM asked a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.repo = a.repo AND h.path = a.path)""",
    "path_resolution": f"""WITH a AS (SELECT DISTINCT file AS path, {_BARE.format('file')} AS bare FROM findings WHERE file IS NOT NULL),
k AS (SELECT DISTINCT {_BARE.format('path')} AS known FROM documents WHERE path IS NOT NULL),
exact AS (SELECT a.path, k.known AS resolved FROM a JOIN k ON a.bare = k.known),
loose AS (SELECT a.path, CASE WHEN count(k.known) = 1 THEN min(k.known) END AS resolved
  FROM a LEFT JOIN k ON (ends_with(k.known, '/' || a.bare) OR ends_with(a.bare, '/' || k.known))
  WHERE a.path NOT IN (SELECT path FROM exact) GROUP BY a.path)
SELECT * FROM exact UNION ALL SELECT * FROM loose""",
    "longest_prefix_module": r"""WITH n AS (SELECT DISTINCT replace(regexp_replace(path, '\.py$', ''), '/', '.') AS name FROM documents WHERE lang = 'python' AND path IS NOT NULL),
m AS (SELECT DISTINCT regexp_replace(name, '\.[^.]*$', '') AS module FROM n)
SELECT name, max_by(module, length(module)) AS module FROM n JOIN m ON n.name = m.module OR starts_with(n.name, m.module || '.') GROUP BY name""",
    "reaching_tests_filter": r"SELECT doc_id, path FROM documents WHERE regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]+$|_test\.\w+$|\.(test|spec)\.\w+$')",
}
