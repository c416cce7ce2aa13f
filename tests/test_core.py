"""Core operators on small tables, with nulls, empties, ties and clashing names."""

import datetime as dt
import hmac
import json
import uuid
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import chunks, diffs, evaluation, findings, graph, metrics, retrieval
from siltstone.operators.components import connected_components
from siltstone.operators.redelivery import assign_requests, superfluous_deliveries, unique_deliveries
from siltstone.operators.skew import hot_keys, lookup_join

PATCH = "@@ -10,3 +10,4 @@ def f\n a\n+b\n+c\n d\n@@ -29,2 +31,2 @@\n-x\n+y\n z\n\\ No newline at end of file"


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


# -- scalar functions


def test_hmac_and_uuid_match_the_library(spark):
    for key in (b"secret", b"k" * 100):
        want = hmac.new(key, b"body \xc3\xa9", "sha256").hexdigest()
        assert value(spark, tx.hmac_sha256(key, F.lit("body é"))) == want
    assert value(spark, tx.signed_by(F.lit(None).cast("string"), b"k", F.lit("x"))) is False
    assert value(spark, tx.uuid5(str(uuid.NAMESPACE_URL), F.lit("repo:a.py:1:9:code"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "repo:a.py:1:9:code"))
    assert value(spark, F.crc32(F.lit("word"))) == zlib.crc32(b"word")


def test_tokens_lines_and_paths(spark):
    assert value(spark, tx.identifier_tokens(F.lit("getHTTPUser snake_case x1"))) == [
        "gethttpuser", "get", "h", "t", "t", "p", "user", "snake_case", "snake", "case", "x1",
    ]
    for text in ("a\r\nb\x0cc\n", "", "a\n\nb", "x\u2028y\x85"):
        assert value(spark, tx.split_lines(F.lit(text))) == text.splitlines()
    assert value(spark, tx.language_of(F.lit("a/B.PY"))) == "python"
    for path, test in (("tests/x.py", True), ("src/test_a.py", True), ("a_test.go", True), ("b.spec.ts", True), ("src/latest.py", False)):
        assert value(spark, tx.is_test_path(F.lit(path))) is test
    assert value(spark, tx.line_of_location(F.lit("L12"))) == 12
    assert value(spark, tx.short_symbol(F.lit("a.py::K.m"))) == "m"
    assert value(spark, tx.clean_label(F.lit("run()"))) == "run"


# -- diffs and chunks


def test_patch_lines(spark):
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, ""), (4, "no hunk"), (5, "@@ -1 +0,0 @@\n-gone")], "k int, patch string")
    lines = diffs.patch_lines(df, "k")
    got = {r.k: r for r in diffs.commentable_lines(lines, "k").collect()}
    assert got[1].added_lines == [11, 12, 31] and got[1].commentable_lines == [10, 11, 12, 13, 31, 32]
    assert set(got) == {1}
    assert diffs.annotate_patch(lines, "k").first().annotated.split("\n")[4].strip() == "-x"


def test_split_git_diff(spark):
    text = (
        "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-a\n+b\n"
        "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+x\n+y\n"
        "diff --git a/o.py b/o.py\n--- a/o.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
        "diff --git a/p.py b/q.py\nrename from p.py\nrename to q.py\n"
    )
    got = one(diffs.split_git_diff(spark.createDataFrame([(1, text)], "k int, diff string"), "k").orderBy("file_no"), "path", "old_path", "status", "additions", "deletions")
    assert got == [("m.py", None, "modified", 1, 1), ("n.py", None, "added", 2, 0), ("o.py", None, "removed", 0, 1), ("q.py", "p.py", "renamed", 0, 0)]


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 300))
def test_windows_cover_every_line(spark, n):
    starts = value(spark, chunks.window_starts(F.lit(1), F.lit(n), 80, 10))
    assert starts[0] == 1 and all(b - a == 70 for a, b in zip(starts, starts[1:]))
    assert starts[-1] + 79 >= n and (len(starts) == 1 or starts[-2] + 79 < n)


def test_chunk_files_and_snippet(spark):
    code = "import os\n\n@dec\ndef a():\n    return 1\n\nclass K:\n    def m(self):\n        pass\n"
    md = "intro\n# One\ntext\n## Two\nmore\n"
    df = spark.createDataFrame([(1, "a.py", code), (2, "b.md", md), (3, "c.go", "x\n" * 100), (4, "d.py", None), (5, "e.bin", "zz"), (6, "f.py", "def broken(:\n")], "k int, path string, text string")
    got = chunks.chunk_files(df, "k")
    assert set(one(got.where("k = 1"), "symbol", "start_line", "end_line")) >= {("a", 3, 5), ("K", 7, 9)}
    assert set(one(got.where("k = 2"), "symbol", "start_line", "end_line")) == {(None, 1, 1), ("One", 2, 3), ("Two", 4, 5)}
    assert set(one(got.where("k = 3"), "start_line", "end_line")) == {(1, 80), (71, 100)}
    assert got.where("k in (4, 5)").count() == 0 and got.where("k = 6").count() == 1
    cut = chunks.window_chunks(df.where("k = 3").withColumn("text", F.lit("\n".join(f"l{i}" for i in range(1, 101)))), "k").withColumn("chunk_id", F.col("start_line"))
    lines = chunks.rebuild_snippet(cut, ["k"], 60, 90).orderBy("line_no").collect()
    assert [r.line for r in lines] == [f"l{i}" for i in range(60, 91)]


# -- graphs


EDGES = [("b", "a", "calls"), ("c", "b", "calls"), ("d", "c", "imports"), ("a", "d", "calls"), ("e", "a", "contains"), ("b", "a", "uses")]


def test_traverse_and_impact(spark):
    e = spark.createDataFrame(EDGES, "source string, target string, relation string")
    seed = spark.createDataFrame([("a",), ("nowhere",), (None,)], "node string")
    got = one(graph.traverse(e, seed, 5, reverse=True), "node", "distance", "via")
    assert sorted(got) == [("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c"), ("e", 1, "a")]
    assert one(graph.impact(e, seed, 2, 2), "node", "in_degree") == [("b", 1), ("e", 0)]
    assert one(graph.callees(e, spark.createDataFrame([("b",)], "node string")), "node") == [("a",)]
    assert graph.traverse(e.where("false"), seed, 2).count() == 0
    stats = dict(one(graph.graph_stats(e.select(F.col("source").alias("node"), F.lit("f").alias("source_file")).distinct(), e), "measure", "n"))
    assert stats["edges"] == 6 and stats["relation:calls"] == 3 and stats["files"] == 1


def test_enclosing_symbols(spark):
    syms = spark.createDataFrame([("f", "K", 1, 50), ("f", "K.m", 10, 20), ("f", "K.n", 10, None), ("g", "h", 5, 6)], "file string, symbol string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", 12), ("f", 5), ("f", 12), ("g", 1), ("f", 60)], "file string, line int")
    got = sorted(one(graph.enclosing_symbols(lines, syms, ["file"]), "file", "line", "symbol"), key=str)
    assert got == [("f", 12, "K.n"), ("f", 5, "K"), ("f", 60, "K.n"), ("g", None, None)]


def test_paths_and_prefixes(spark):
    known = spark.createDataFrame([("src/a/x.py",), ("lib/x.py",), ("b/y.py",), ("z.py",)], "path string")
    asked = spark.createDataFrame([("./b/y.py",), ("a/x.py",), ("x.py",), ("root/z.py",), ("none.py",), (None,)], "path string")
    assert dict(one(graph.resolve_paths(asked, known), "path", "resolved")) == {"./b/y.py": "b/y.py", "a/x.py": "src/a/x.py", "x.py": None, "root/z.py": "z.py", "none.py": None}
    mods = spark.createDataFrame([("a",), ("a.b",)], "module string")
    assert dict(one(graph.longest_prefix(spark.createDataFrame([("a.b.c",), ("a.x",), ("q",)], "name string"), mods), "name", "module")) == {"a.b.c": "a.b", "a.x": "a"}


def test_python_graph(spark):
    files = spark.createDataFrame(
        [("pkg/a.py", "def helper():\n    pass\n\ndef main():\n    helper()\n"), ("pkg/b.py", "from pkg.a import helper\n\nclass Base:\n    def go(self):\n        self.stop()\n    def stop(self):\n        helper()\n\nclass Sub(Base):\n    pass\n"), ("bad.py", "def (")],
        "path string, text string",
    )
    nodes, edges = graph.python_graph(files)
    got = set(one(edges.where("relation <> 'contains'"), "source", "target", "relation"))
    assert got == {
        ("pkg/a.py::main", "pkg/a.py::helper", "calls"), ("pkg/b.py::Base.go", "pkg/b.py::Base.stop", "calls"), ("pkg/b.py::Base.stop", "pkg/a.py::helper", "calls"),
        ("pkg/b.py", "pkg/a.py", "imports"), ("pkg/b.py::Sub", "pkg/b.py::Base", "inherits"),
    }
    assert nodes.where("kind = 'method'").count() == 2


def test_components_with_hub_and_chain(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 180)]
    df = spark.createDataFrame(chain + hub + [(7, 7), (500, 500), (None, 3)], "src int, dst int")
    got = dict(one(connected_components(df), "node", "component"))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 180)} == {100} and got[500] == 500
    assert connected_components(df.where("false")).count() == 0


def test_lookup_join_splits_hot_keys(spark):
    rows = spark.range(70_000).select(F.when(F.col("id") < 40_000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.select("k").distinct().where("k < 50000").withColumn("v", F.col("k") * 2)
    assert hot_keys(rows, "k") == [1]
    assert lookup_join(rows, table, "k").count() == 50_000
    assert lookup_join(rows, table, "k", "left").where("v is null").count() == 20_000


# -- retrieval


@pytest.mark.parametrize("block, at_once", [(4096, 512), (3, 2)])
def test_hybrid_search_against_all_pairs(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(retrieval, "HYBRID_BLOCK", block)
    monkeypatch.setattr(retrieval, "ITEMS_AT_ONCE", at_once)
    words = [f"{a}{b}" for a in ("load", "parse", "send", "tile") for b in ("File", "_row", "")]
    texts = [(i, " ".join(words[(i * j) % 11 + (i > 20)] for j in range(1, 3 + i % 5))) for i in range(30)] + [(7, "tile loadFile"), (40, ""), (41, None)]
    items = spark.createDataFrame(texts, "item long, text string").repartition(3)
    queries = spark.createDataFrame([(q, t) for q, t in texts if q % 4 == 0] + [(99, "nowhere"), (98, "")], "query long, text string")
    k = 2
    got = sorted(one(retrieval.hybrid_search(queries, items, k), "query", "item", "score", "rank"))
    # by joins: every pair of a query and an item is a row
    terms, want = retrieval.term_frequency(items, "item"), retrieval.term_frequency(queries, "query")
    weigh = lambda t, key: t.select(key, "token", (1 + F.log("n")).alias("weight"))
    sparse = retrieval.sparse_search(weigh(want, "query"), weigh(terms, "item"), retrieval.inverse_frequency(terms, "item", items.count()), retrieval.PREFETCH * k)
    b = retrieval.dense_vectors(want, "query").withColumnRenamed("value", "q")
    near = retrieval.dense_vectors(terms, "item").join(b, "dim").groupBy("query", "item").agg(F.round(F.sum(F.col("value") * F.col("q")), 9).alias("score"))
    fused = retrieval.fuse([retrieval.best(near, "query", "item", retrieval.PREFETCH * k), sparse], k)
    assert got == sorted(one(fused, "query", "item", "score", "rank")) and len(got) >= 16
    assert retrieval.hybrid_search(queries.where("false"), items, k).count() == 0


def test_hash_embedding_and_fusion(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma"), (3, None), (4, "")], "id int, text string")
    dense = retrieval.dense_vectors(retrieval.term_frequency(df, "id"), "id")
    norms = dict(one(dense.groupBy("id").agg(F.round(F.sum(F.col("value") ** 2), 9).alias("n")), "id", "n"))
    assert norms == {1: 1.0, 2: 1.0}
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query int, item string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query int, item string, rank int")
    assert one(retrieval.fuse([a, b], 2).orderBy("rank"), "item") == [("y",), ("x",)]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "item int, vector array<float>")
    assert retrieval.dense_search(zero.withColumnRenamed("item", "query"), zero, 1).where("query = 2").first().item == 2


# -- findings


def _finding(i, **over):
    row = dict(id=f"f{i}", job_id="j", repo="r", agent="reviewer", file="a.py", line=10, end_line=None, severity="warning", category="bug", title="Title", message="Message", suggestion=None, confidence=0.9, evidence=["e"], reported_by=[], reported_at=None)
    return row | over


_SCHEMA = "id string, job_id string, repo string, agent string, file string, line int, end_line int, severity string, category string, title string, message string, suggestion string, confidence double, evidence array<string>, reported_by array<string>, reported_at timestamp"


def test_sanitize(spark):
    df = spark.createDataFrame([_finding(1, file="./a.py", line=-4, severity=" CRITICAL ", category="odd", confidence=0.0, suggestion=""), _finding(2, file=""), _finding(3, confidence=7.0, evidence=None, reported_by=None, end_line=3), _finding(4, file=None)], _SCHEMA)
    got = {r.id: r for r in findings.sanitize(df).collect()}
    assert set(got) == {"f1", "f3"}
    assert (got["f1"].file, got["f1"].line, got["f1"].severity, got["f1"].category, got["f1"].confidence, got["f1"].suggestion) == ("a.py", None, "critical", "bug", 0.5, None)
    assert (got["f3"].confidence, got["f3"].end_line, got["f3"].evidence) == (1.0, 10, [])


def test_parse_findings(spark):
    text = json.dumps({"findings": [{"file": "a.py", "line": 3, "severity": "nope"}, {"file": ""}]})
    df = spark.createDataFrame([("j1", text), ("j2", "not json"), ("j3", None)], "k string, body string")
    assert one(findings.parse_findings(df, "k", "body"), "id", "severity", "category") == [("j1-0", "info", "bug")]


def test_greedy_clusters_and_consensus(spark):
    rows = [
        _finding(1, severity="critical", category="security", agent="security", line=12, confidence=0.9),
        _finding(2, category="security", agent="reviewer", line=10, evidence=["x", "y", "z"], suggestion="do"),
        _finding(3, category="bug", title="Other thing entirely", message="unlike", line=40),
        _finding(4, category="style", title="Zebra", message="quite different words", line=11),
    ]
    merged = {r.id: r for r in findings.greedy_clusters(findings.sanitize(spark.createDataFrame(rows, _SCHEMA))).collect()}
    assert set(merged) == {"f1", "f3", "f4"}
    assert merged["f1"].reported_by == ["reviewer", "security"] and round(merged["f1"].confidence, 6) == 0.94
    assert merged["f1"].evidence == ["e", "x", "y"] and merged["f1"].suggestion == "do"


def test_rules_and_gaps(spark):
    lines = spark.createDataFrame(
        [("j", "a.py", 1, "cur.execute(f'select {x}')"), ("j", "a.py", 2, "requests.get(url)"), ("j", "a.py", 3, "requests.get(url, timeout=3)"), ("j", "a.py", 4, "def new(a, b=[]):"), ("k", "tests/test_a.py", 1, "def other():"), ("k", "b.py", 1, "def more():"), ("j", "a.py", 5, None)],
        "job_id string, file string, new_line int, text string",
    )
    got = set(one(findings.scan_rules(lines, ["job_id"]), "line", "title"))
    assert got == {(1, "SQL injection"), (2, "HTTP call without timeout"), (4, "Mutable default argument")}
    assert one(findings.scan_test_gaps(lines, "job_id"), "title") == [("No test for `new`",)]


def test_classify_codes(spark):
    for code, want in (("E902", ("critical", "bug")), ("S608", ("critical", "security")), ("S311", ("warning", "security")), ("F401", ("nitpick", "maintainability")), ("BLE001", ("warning", "bug")), ("ASYNC1", ("info", "performance")), ("W1", ("info", "style"))):
        sev, cat = findings.classify_code(F.lit(code))
        assert (value(spark, sev), value(spark, cat)) == want


def test_judging_and_verdicts(spark):
    f = findings.sanitize(spark.createDataFrame([_finding(1), _finding(2, agent="static", confidence=0.1), _finding(3), _finding(4, job_id="k")], _SCHEMA))
    j = spark.createDataFrame([("f1", 1, True, 0.9, "critical", "ok"), ("f3", 1, True, 0.9, None, "first"), ("f3", 2, False, 0.9, None, "last"), ("f4", 1, True, 0.2, "odd", "weak")], "id string, ordinal int, keep boolean, confidence double, severity string, reason string")
    judged = {r.id: r for r in findings.apply_judgments(f, j).collect()}
    assert [judged[i].kept for i in ("f1", "f2", "f3", "f4")] == [True, True, False, False]
    assert judged["f3"].evidence[-1] == "critic: last" and judged["f1"].severity == "critical"
    assert dict(one(findings.verdicts(findings.apply_judgments(f, j)), "job_id", "verdict")) == {"j": "request_changes", "k": "approve"}


def test_fan_in_deadline(spark):
    t0 = dt.datetime(2025, 1, 1)
    jobs = spark.createDataFrame([("j", t0, ["a", "b"]), ("k", t0, [])], "job_id string, created_at timestamp, expected_agents array<string>")
    results = spark.createDataFrame([(1, "j", "a", None, t0), (2, "j", "a", "late copy", t0 + dt.timedelta(seconds=1)), (3, "j", "b", None, t0 + dt.timedelta(seconds=301)), (4, "k", "a", "x" * 500, t0)], "result_id long, job_id string, agent string, error string, arrived_at timestamp")
    got = {(r.job_id, r.agent): r.status for r in findings.fan_in(results, jobs, ["a"]).collect()}
    assert got[("j", "a")] == "ok" and got[("j", "b")] == "timeout" and len(got[("k", "a")]) == 127


# -- metrics and evaluation


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 3.0), ("a", 1e9), ("a", None), ("b", 1.0)], "agent string, s double")
    h = metrics.histogram(rows, ["agent"], "s", [1, 5])
    assert sorted(one(h, "agent", "le", "n")) == [("a", 1.0, 1), ("a", 5.0, 2), ("a", float("inf"), 3), ("b", 1.0, 1), ("b", 5.0, 1), ("b", float("inf"), 1)]
    q = dict(one(metrics.histogram_quantile(h, ["agent"], 0.5), "agent", "value"))
    assert q == {"a": 3.0, "b": 0.5}
    c = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 8.0), ("s", 3, 2.0)], "k string, t int, v double")
    assert [r.growth for r in metrics.increase(c, ["k"], "t", "v").orderBy("t").collect()] == [0.0, 3.0, 2.0]
    assert value(spark, metrics.ratio(F.lit(None).cast("int"), F.lit(0))) == 0
    assert value(spark, metrics.desired_replicas(F.lit(11), 2)) == 6


def test_evaluation(spark):
    found = spark.createDataFrame([("c1", "1", "a.py", 13, "bug", "warning"), ("c1", "2", "a.py", 99, "bug", "warning"), ("c2", "3", "b.py", 1, "testing", "info")], "case string, id string, file string, line int, category string, severity string")
    want = spark.createDataFrame([("c1", 1, "a.py", 5, 10), ("c1", 1, "z.py", 1, 2), ("c3", 2, "q.py", 1, 1)], "case string, expected_id int, file string, first int, last int")
    s = evaluation.summarize(evaluation.score_cases(found, want, "case")).first()
    assert (s.expected, s.hit, s.defects, s["true"], s.precision, s.recall) == (2, 1, 2, 1, 0.5, 0.5)


# -- messages delivered more than once


JOBS = "delivery_id long, job_id string, repo string, pr_number long, head_sha string, received_at timestamp, bucket string, first string"
U = "0123456789abcdef0123456789abcdef"


def _jobs(spark):
    t = dt.datetime(2025, 1, 1)
    sha = "ab" * 20
    return spark.createDataFrame(
        [
            (1, f"urn:uuid:{uuid.UUID(U)}", "r", 1, sha, t, "clash", "clash"), (2, "{" + str(uuid.UUID(U)).upper() + "}", "r", 2, None, t + dt.timedelta(days=9), None, None),
            (3, None, "r", 1, sha.upper() + " ", None, None, None), (4, "not a uuid", "r", 1, sha[:12], t, None, None), (5, "not a uuid", "r", 1, "0" * 40, t, None, None),
            (6, None, "r", 1, "", t, None, None), (7, None, "r", 1, "", t, None, None), (8, f" {U} ", "other", None, "cd" * 20, t, None, None),
            (9, None, "other", 5, "cd" * 20, t, None, None), (10, None, None, 5, "cd" * 20, t, None, None), (None, U, "r", 1, sha, t, None, None), (1, f"urn:uuid:{uuid.UUID(U)}", "r", 1, sha, t, "clash", "clash"),
        ],
        JOBS,
    )


def test_redelivery(spark):
    jobs = _jobs(spark)
    got = dict(one(assign_requests(jobs), "delivery_id", "request_id"))
    assert {got[i] for i in (1, 2, 3, 4, 8)} == {1} and all(got[i] == i for i in (5, 6, 7, 9, 10)) and len(got) == 10
    assert sorted(one(superfluous_deliveries(jobs), "delivery_id")) == [(2,), (3,), (4,), (8,)]
    assert unique_deliveries(jobs).count() == 6
    assert assign_requests(jobs.where("false")).count() == 0


def test_redelivery_with_a_third_in_one_request(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 == 0, U).otherwise(F.md5(F.col("id").cast("string"))).alias("job_id"), F.lit("r").alias("repo"), F.col("id").alias("pr_number"),
        F.sha1(F.col("id").cast("string")).alias("head_sha"), F.timestamp_seconds(F.col("id") * 5000).alias("received_at"),
    )
    assert superfluous_deliveries(rows).count() == 999


# -- streaming, sources, engine


def test_fan_in_stream(spark, tmp_path):
    from siltstone.streaming import jobs as sj

    t0, s = dt.datetime(2025, 1, 1), lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)
    jobs = [("j", t0, ["a", "b"]), ("k", t0, ["a"]), ("m", t0 + dt.timedelta(days=9), ["a"]), ("late", t0, ["a"]), ("two", s(5), ["a", "b"]), ("two", t0, ["b", "b"]), ("none", t0, None), (None, t0, ["a"]), ("x", None, ["a"])]
    results = [("j", "a", None, t0, 1), ("k", "a", None, t0, 3), ("k", "a", "again", t0, 4), ("late", "a", None, s(301), 5), ("two", "b", "bad", s(300), 6), ("two", "b", None, s(300), 7), ("unknown", "a", None, t0, 8), ("none", "a", None, s(1), 9), ("j", None, None, t0, 10)]
    spark.createDataFrame(jobs, "job_id string, created_at timestamp, expected_agents array<string>").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame(results, "job_id string, agent string, error string, arrived_at timestamp, result_id long").write.parquet(f"{tmp_path}/res.parquet")
    got = {r.job_id: (r.complete, json.loads(r.agents)) for r in sj.fan_in_table(spark, str(tmp_path), "jobs", "res", ["a"]).collect()}
    assert got == {
        "j": (False, {"a": "ok", "b": "timeout"}), "k": (True, {"a": "ok"}), "m": (False, {"a": "timeout"}), "late": (False, {"a": "timeout"}),
        "two": (True, {"b": "error: bad"}), "none": (True, {"a": "ok"}),
    }


def test_fan_in_state_is_removed():
    from types import SimpleNamespace

    from siltstone.streaming import jobs as sj

    class State:
        exists, hasTimedOut, kept, at = False, False, None, 0

        def update(self, v):
            self.exists, self.get = True, v

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, t):
            self.due = t

        def getCurrentWatermarkMs(self):
            return self.at

    state, t0 = State(), pd.Timestamp(2025, 1, 1)
    row = lambda **k: pd.DataFrame([SimpleNamespace(**k).__dict__])
    job = row(kind="job", agent=None, status=None, result_id=0, at=t0, expected=["a"])
    result = row(kind="result", agent="a", status="ok", result_id=1, at=t0, expected=[])
    assert not list(sj._gather(("j",), iter([result]), state)) and state.exists
    assert len(list(sj._gather(("j",), iter([job]), state))) == 1
    state.at = state.due + 1
    assert not list(sj._gather(("j",), iter([result]), state))  # a later copy changes nothing
    state.hasTimedOut = True
    assert not list(sj._gather(("j",), iter([]), state)) and not state.exists


def test_rows_are_tried_again_then_go_to_the_dead_letters(spark):
    from siltstone.streaming import jobs as sj

    def handle(value):
        failed = handle.__dict__.setdefault("failed", set())
        if value is None or value == "bad" or (value == "shaky" and value not in failed and not failed.add(value)):
            raise ValueError("x" * 900)
        return value.upper()

    m = spark.createDataFrame([("t", "1", "good"), ("t", "2", "bad"), ("t", "3", "shaky"), ("t", "4", None)], "topic string, key string, value string").coalesce(1)
    got = {r.key: (r.result, r.outcome, r.error and len(r.error), r.attempts) for r in sj.handle_rows(m, handle, wait=None).collect()}
    assert got == {"1": ("GOOD", "ok", None, 1), "2": (None, "dlq", 500, 3), "3": ("SHAKY", "retry", None, 2), "4": (None, "dlq", 500, 3)}
    assert [sj.backoff(n) for n in (1, 2, 3, 9)] == [2, 4, 8, 30]


def test_dead_letters_and_status(spark):
    from siltstone.streaming import jobs as sj

    m = spark.createDataFrame([("t", "k", "{}"), ("t", "k", "oops"), ("t", None, None)], "topic string, key string, value string")
    good, dead = sj.with_dead_letters(m)
    assert good.count() == 1 and dead.count() == 2
    log = spark.createDataFrame([("j", "judging"), ("j", "agents"), ("k", "queued")], "job_id string, status string")
    assert dict(one(sj.latest_status(log), "job_id", "status")) == {"j": "judging", "k": "queued"}


def test_code_graph_reader_and_edits(spark, tmp_path):
    from siltstone.sources import files as sf

    doc = {"nodes": [{"id": "n", "label": "run()", "file_type": "code", "source_file": "/root/x/a.py", "source_location": "L7"}], "edges": [{"source": "n", "target": "m", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = sf.code_graph(spark, str(tmp_path / "g.json"), "/root/x")
    assert one(nodes, "source_file", "start_line", "kind") == [("a.py", 7, "code")] and edges.count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "edits": [{"file": "a.py", "find": "1", "replace": "2"}]}))
    edits = sf.seeded_cases(spark, str(tmp_path / "c.json"))
    assert one(sf.apply_edits(edits, spark.createDataFrame([("a.py", "x = 1")], "path string, text string")), "text") == [("x = 2",)]
    with pytest.raises(Exception, match="exactly once"):
        sf.apply_edits(edits, spark.createDataFrame([("a.py", "1 1")], "path string, text string")).collect()
    assert value(spark, sf.anchor_range(F.lit("a\nb\nc\n"), "b\nc")) == (2, 3)


def test_engine(spark, tmp_path):
    from siltstone.engine import Engine

    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("def hidden():\n    pass\n")
    (tmp_path / "pkg" / "tax.py").write_text("def compute_tax(x):\n    return x * 2\n")
    (tmp_path / "pkg" / "order.py").write_text("from pkg.tax import compute_tax\n\ndef total(x):\n    return compute_tax(x)\n")
    (tmp_path / "test_order.py").write_text("from pkg.order import total\n\ndef test_total():\n    assert total(1)\n")
    engine = Engine(spark)
    engine.index("shop", str(tmp_path))
    assert one(engine.impact_for_range("shop", "pkg/tax.py", 2, 2), "node", "distance") == [("pkg/order.py::total", 1), ("test_order.py::test_total", 2)]
    assert one(engine.find_tests("shop", "compute_tax"), "node") == [("test_order.py::test_total",)]
    top = engine.search("shop", "compute tax").orderBy("rank").first()
    assert engine.indexes["shop"]["chunks"].where(F.col("chunk_id") == top.item).first().path.startswith("pkg/")
    assert [r.line for r in engine.read_snippet("shop", "pkg/order.py", 3, 4).collect()] == ["def total(x):", "    return compute_tax(x)"]
    with pytest.raises(LookupError):
        engine.stats("other")
    found, verdict = engine.review(spark.createDataFrame([("j", "pkg/a.py", "@@ -0,0 +1,1 @@\n+eval(x)")], "job_id string, path string, patch string"))
    assert found.count() == 1 and verdict.first().verdict == "request_changes"


def test_ablation_of_more_than_64_agents(spark, monkeypatch):
    from siltstone.plans import reviews

    found = spark.createDataFrame([(f"f{i}", "r", f"a{i:02}", "x.py", 3, 3, "bug", "info", "t", "m", 0.9) for i in range(70)], "id string, repo string, agent string, file string, line int, end_line int, category string, severity string, title string, message string, confidence double")
    wanted = spark.createDataFrame([("r", 1, "x.py", 1, 5), ("r", 2, "y.py", 1, 5)], "case string, expected_id long, file string, first int, last int")
    monkeypatch.setattr(reviews, "_clean", lambda s, d: found)
    monkeypatch.setattr(reviews, "_expected", lambda s, d: wanted)
    rows = reviews.eval_ablation(spark, "").collect()
    assert len(rows) == 70 and {r.recall for r in rows} == {0.5}


def test_relative_imports_and_aliases(spark, tmp_path):
    from siltstone.engine import Engine

    files = {
        "pkg/__init__.py": "from .a import f as g\n", "pkg/a.py": "def f(x):\n    return x + 1\n\n\nclass K:\n    def m(self):\n        return self.n()\n\n    def n(self):\n        return f(2)\n",
        "pkg/b.py": "from .a import f\nfrom . import a\n\n\ndef use():\n    return f(1)\n", "pkg/sub/c.py": "from ..a import f as h\n\n\ndef deep():\n    return h(3)\n",
        "tests/test_a.py": "from pkg.b import use\n\n\ndef test_use():\n    assert use() == 2\n", "site-packages/x.py": "y = 1\n", "README.md": "# Guide\n\nhow to use f\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    engine = Engine(spark)
    index = engine.index("r", str(tmp_path))
    got = set(one(index["edges"].where("relation <> 'contains'"), "source", "target", "relation"))
    assert got == {
        ("pkg/__init__.py", "pkg/a.py", "imports"), ("pkg/b.py", "pkg/a.py", "imports"), ("pkg/sub/c.py", "pkg/a.py", "imports"), ("tests/test_a.py", "pkg/b.py", "imports"),
        ("pkg/a.py::K.m", "pkg/a.py::K.n", "calls"), ("pkg/a.py::K.n", "pkg/a.py::f", "calls"), ("pkg/b.py::use", "pkg/a.py::f", "calls"), ("pkg/sub/c.py::deep", "pkg/a.py::f", "calls"), ("tests/test_a.py::test_use", "pkg/b.py::use", "calls"),
    }
    changed = spark.createDataFrame([("pkg/a.py", "@@ -1,1 +1,2 @@\n def f(x):\n+    return x + 1"), ("new.py", None)], "path string, patch string")
    report = engine.impact_report("r", changed)
    assert "new.py: not in graph" in report and "[d1] deep [function] @ pkg/sub/c.py:4 (calls ← f)" in report and report.endswith("test_use [function] @ tests/test_a.py:4")
    assert len(engine.impact_report("r", changed, budget=120)) == 120
    packed = engine.pack_context("r", changed)
    assert "--- dependent: use" in packed and "    5  def use():" in packed and len(engine.pack_context("r", changed, 700)) <= 700
    tools = engine.tools("r", ["get_callers", "search_code"])
    assert set(tools) == {"get_callers", "search_code"} and "Callers of f" in tools["get_callers"](symbol="f") and tools["get_callers"](sym="f").startswith("error")
    assert engine.tests_report("r", "nothing").startswith("No symbol")
    assert "pkg/b.py" not in engine.search_report("r", "def use return f", "code", 3, ["pkg/b.py"]) and "Guide" in engine.search_report("r", "guide", "doc")
    with pytest.raises(LookupError):
        engine.impact_report("other", changed)


def test_cut_lines_and_blocks(spark):
    from siltstone.operators import reports

    lines = spark.createDataFrame([(i, "x" * 10) for i in range(1, 6)], "pos int, line string")
    assert reports.joined(reports.cut_lines(lines, 35, title="title")).first()["report"] == "title\n" + "\n".join(["x" * 10] * 3) + "\n  … 2 more truncated"
    assert reports.joined(reports.cut_lines(lines.where("false"), 35, title="title")).first()["report"] == "title\n  (none found in graph)"
    blocks = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 4), ("o", 1, 50)], "k string, pos int, n int")
    assert sorted(one(reports.fitting_blocks(blocks, 10, ["k"]), "k", "pos", "fits")) == [("k", 1, True), ("k", 2, False), ("k", 3, False), ("o", 1, False)]
    assert sorted(one(reports.fitting_blocks(blocks, 10, ["k"], skip=True), "k", "pos", "fits")) == [("k", 1, True), ("k", 2, False), ("k", 3, True), ("o", 1, False)]


def test_stores(spark, tmp_path):
    from siltstone.sources import store

    graphs = store.GraphStore(spark, str(tmp_path / "g"))
    nodes, edges = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b")], "source string, target string")
    with pytest.raises(LookupError):
        graphs.get("o/r")
    assert graphs.put("o/r", nodes, edges) == 1 and graphs.put("o/r", nodes.unionByName(nodes), edges) == 2
    assert graphs.get("o/r")[0].count() == 2 and graphs.get("o/r", 1)[0].count() == 1
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    log = spark.createDataFrame([("a", "1", t(0), 10), ("a", "2", t(1), None), ("b", "1", t(0), 5), ("c", "1", t(0), None), ("c", None, t(1), None), (None, "1", t(0), None)], "key string, value string, at timestamp, ttl long")
    assert one(store.live_state(log, t(7)), "key", "value") == [("a", "2")]
    acks = spark.createDataFrame([("g", "t", 0, 3), ("g", "t", 0, 1), ("g", "t", 1, None)], "group string, topic string, partition int, offset long")
    assert one(store.committed_offsets(acks), "group", "topic", "partition", "next") == [("g", "t", 0, 4)]
    assert one(store.due_members(spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 9.0)], "member string, score double"), 2.0), "member") == [("b",), ("a",)]
    md = store.write_evaluation(spark.createDataFrame([("x", 1.0)], "mode string, f1 double"), str(tmp_path / "e")).first()["markdown"]
    assert md == "| mode | f1 |\n| --- | --- |\n| x | 1.0 |" and spark.read.json(str(tmp_path / "e")).count() == 1


def test_dense_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).round(1)
    v[7] = 0
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (999, None)], "item long, vector array<double>").repartition(5)
    queries = items.where("item % 20 = 0").selectExpr("item as query", "vector")
    got = {(q, r): i for q, i, r in one(retrieval.dense_search(queries, items, 4, 6), "query", "item", "rank")}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in range(0, 200, 20):
        scores = np.round(unit @ unit[q], 6)
        assert [got[q, r] for r in range(1, 5)] == sorted(range(200), key=lambda i: (-scores[i], i))[:4]


def test_identifier_store_reads_matching_buckets_only(spark, tmp_path):
    from siltstone.operators.redelivery import IdentifierStore

    store = IdentifierStore(spark, str(tmp_path / "ids"), bits=8)
    assert store.seen(spark.createDataFrame([("a",)], "ident string")).count() == 0
    for bucket in range(4):
        store.add(spark.createDataFrame([(f"{bucket}-{i}", bucket) for i in range(50)] + [(None, bucket)], "ident string, bucket int"))
    batch = spark.createDataFrame([("2-7",), ("2-7",), ("new",), (None,), ("2-49",)], "ident string")
    assert sorted(one(store.seen(batch), "ident")) == [("2-49",), ("2-7",)]
    maybe = store.maybe_seen(spark.createDataFrame([(f"fresh-{i}",) for i in range(2000)], "ident string"))
    assert maybe.count() < 2000 * 4 * 0.05
    store.add(spark.createDataFrame([("2-7", 2)], "ident string, bucket int"))
    assert store.seen(batch).count() == 2


def test_an_abbreviation_of_two_commits_denotes_neither(spark):
    a, b = "abcdef1" + "0" * 33, "abcdef1" + "1" * 33
    rows = [(1, None, "r", 5, a), (2, None, "r", 5, b), (3, None, "r", 5, "abcdef1"), (4, None, "r", 5, "ABCDEF10000"), (5, None, "r", 5, "abcdef1"), (6, None, "r", 6, "abcdef1"), (7, None, "r", 6, b)]
    jobs = spark.createDataFrame([(*r, dt.datetime(2025, 1, 1)) for r in rows], "delivery_id long, job_id string, repo string, pr_number long, head_sha string, received_at timestamp")
    assert dict(one(assign_requests(jobs), "delivery_id", "request_id")) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 3, 6: 6, 7: 6}
