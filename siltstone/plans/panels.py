"""Event routing, request guards, job summaries, dashboard panels and hybrid search as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import bare_path, hash32
from siltstone.operators import events, findings, metrics, retrieval
from siltstone.plans.graphs import _LINES
from siltstone.plans.reviews import _CLEAN, _FAN, _RULES_SQL, AGENTS
from siltstone.plans.texts import _TOK
from siltstone.sources.tables import table


def event_routing(spark, d):
    """Webhook bodies made of the deliveries, routed again."""
    jobs = table(spark, d, "review_jobs").select("delivery_id", "repo", "pr_number", "head_sha")
    branch = table(spark, d, "repositories").select("repo", "default_branch")
    n = F.col("delivery_id")
    action = F.element_at(F.array(*map(F.lit, ["opened", "closed", "synchronize", "labeled", "reopened"])), (n % 5 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            action.alias("action"), F.concat(F.lit("refs/heads/"), F.when(n % 3 == 0, "work").otherwise(F.coalesce("default_branch", F.lit("main")))).alias("ref"), F.col("head_sha").alias("after"),
            F.struct(F.col("repo").alias("full_name"), "default_branch").alias("repository"),
            F.struct(F.col("pr_number").alias("number"), (n % 7 == 0).alias("draft"), F.struct(F.col("head_sha").alias("sha")).alias("head")).alias("pull_request"),
            F.array(F.struct(F.array(F.concat(F.lit("b"), n.cast("string"))).alias("added"), F.array(F.lit("a")).alias("modified"), F.array().cast("array<string>").alias("removed")), F.struct(F.array(F.lit("a")).alias("added"), F.lit(None).cast("array<string>").alias("modified"), F.array(F.lit("c")).alias("removed"))).alias("commits"),
        )
    )
    rows = jobs.join(branch, "repo", "left").select("delivery_id", F.when(F.col("pr_number") > 0, "pull_request").otherwise("push").alias("kind"), (n % 11 > 0).alias("signed"), body.alias("body"))
    return events.route_events(rows).select("delivery_id", "route", "repo", "sha", "paths")


def request_guards(spark, d):
    """Per delivery: name and size guards, and the agents that would work on it."""
    j = table(spark, d, "review_jobs")
    wanted = F.filter(F.array(*map(F.lit, AGENTS)), lambda a: events.expects(F.col("expected_agents"), a))
    return j.select("delivery_id", events.repository_name(F.col("repo")).alias("named"), events.head_files_fit(F.col("head_files"), 20_000).alias("fits"), wanted.alias("agents"))


def changed_head_files(spark, d):
    """Head files of a delivery whose path its job changed."""
    paths = table(spark, d, "changed_files").where("path is not null").groupBy("job_id").agg(F.collect_set("path").alias("paths"))
    j = table(spark, d, "review_jobs").where("job_id is not null and head_files is not null").select("delivery_id", "job_id", "head_files").join(paths, "job_id")
    return j.select("delivery_id", F.size(events.head_files_of(F.col("head_files"), F.col("paths"))).alias("n_files"))


def static_targets(spark, d):
    return table(spark, d, "changed_files").where(events.static_target(F.col("path"), F.col("status"))).select("change_id", "path")


def job_summaries(spark, d):
    """Jobs with title, state of their agents and findings per severity: jobs need a status, the rest may be missing."""
    jobs = table(spark, d, "review_jobs").where("job_id is not null").groupBy("job_id").agg(F.min_by(F.struct("repo", "title"), F.struct("created_at", "delivery_id")).alias("j"))
    state = findings.fan_in(table(spark, d, "agent_results"), table(spark, d, "review_jobs").where("job_id is not null"), AGENTS)
    done = state.groupBy("job_id").agg(F.count("*").alias("expected"), F.count_if(F.col("status") == "ok").alias("ok"))
    tally = findings.severity_pivot(findings.sanitize(table(spark, d, "findings")), "job_id")
    out = jobs.join(done, "job_id").join(tally, "job_id", "left").na.fill(0, findings.SEVERITIES)
    return out.select("job_id", "j.repo", "j.title", "expected", "ok", *findings.SEVERITIES)


def _results(spark, d):
    return table(spark, d, "agent_results").where("arrived_at is not null")


def input_tokens_by_agent(spark, d):
    """Input and cache-read tokens per agent and five minutes."""
    tokens = F.coalesce("usage_stats.input_tokens", F.lit(0)) + F.coalesce("usage_stats.cache_read_tokens", F.lit(0))
    return metrics.windowed_count(_results(spark, d), "arrived_at", "5 minutes", ["agent"], value=tokens)


def tool_calls_by_window(spark, d):
    r = _results(spark, d).select("arrived_at", F.explode("tool_calls").alias("tool", "calls"))
    return metrics.windowed_count(r, "arrived_at", "5 minutes", ["tool"], value=F.col("calls"))


def results_by_outcome(spark, d):
    r = _results(spark, d).withColumn("outcome", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    return metrics.windowed_count(r, "arrived_at", "5 minutes", ["outcome"])


def failures_24h(spark, d):
    """Failed results of the last 24 hours that there are results of, zero where there are none."""
    r = _results(spark, d).select("arrived_at", "error")
    last = r.agg(F.max("arrived_at").alias("last"))
    return r.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("error").isNotNull() & (F.col("arrived_at") > F.col("last") - F.expr("interval 24 hours"))).alias("n"))


def value_p95_by_type(spark, d):
    """The 95th percentile of event values out of histogram buckets."""
    h = metrics.histogram(table(spark, d, "events"), ["event_type"], "value", [1, 5, 10, 25, 50, 100, 250, 500])
    return metrics.histogram_quantile(h, ["event_type"], 0.95).select("event_type", F.round("value", 6).alias("value"))


def hybrid_search(spark, d):
    """Symbols and paths of the stated query set against the texts of all chunks: dense and sparse search, fused."""
    q = table(spark, d, "chunks").where("chunk_id % 100 = 0 and text is not null").select(F.col("chunk_id").alias("query"), F.concat_ws(" ", "symbol", "path").alias("text"))
    items = table(spark, d, "chunks").where("text is not null").select(F.col("chunk_id").alias("item"), "text")
    return retrieval.hybrid_search(q, items, 5, hash32, 5).select("query", "item", F.round("score", 4).alias("score"))


def static_agent(spark, d):
    """Diagnostics with absolute file names, made of the findings, on added lines."""
    from siltstone.operators.diffs import patch_lines

    files = table(spark, d, "changed_files").where("path is not null").select("change_id", "job_id", bare_path(F.col("path")).alias("file"))
    added = patch_lines(table(spark, d, "changed_files"), "change_id").where("kind = '+'").join(files, "change_id").select("job_id", "file", F.col("new_line").alias("line"))
    code = F.element_at(F.array(*map(F.lit, ["E999", "S602", "F401", "B006", "PERF401"])), (F.col("line") % 5 + 1).cast("int"))
    diags = added.distinct().where("line % 3 = 0").select("job_id", F.concat(F.lit("/work/"), "file").alias("filename"), F.col("line").alias("row"), code.alias("code"), F.lit("made").alias("message"))
    more = diags.withColumn("row", F.col("row") + 100_000)
    return events.added_line_diagnostics(diags.unionByName(more), added, ["job_id"])


QUERIES = {f.__name__: f for f in (
    event_routing, request_guards, changed_head_files, static_targets, job_summaries, input_tokens_by_agent, tool_calls_by_window, results_by_outcome, failures_24h, value_p95_by_type, hybrid_search, static_agent,
)}
_FILES = r"cfl AS (SELECT change_id, job_id, regexp_replace(path, '^(\./)+', '') AS file FROM changed_files WHERE path IS NOT NULL)"
_ADDED = r"al AS (SELECT d.change_id, c.job_id, c.path AS file, d.new_line::INT AS line, d.text FROM dl d JOIN changed_files c USING (change_id) WHERE d.kind = '+')"
ORACLES = {
    "event_routing": """WITH j AS (SELECT delivery_id AS n, repo, pr_number, head_sha, coalesce(default_branch, 'main') AS b FROM review_jobs LEFT JOIN repositories USING (repo)),
r AS (SELECT *, CASE WHEN n % 11 = 0 OR NOT coalesce(regexp_full_match(repo, '[\\w.-]+/[\\w.-]+') AND NOT contains(repo, '..'), FALSE) THEN 'ignored'
  WHEN pr_number > 0 THEN CASE WHEN n % 5 IN (0, 2, 4) AND n % 7 <> 0 THEN 'review' ELSE 'ignored' END WHEN n % 3 <> 0 THEN 'index' ELSE 'ignored' END AS route FROM j)
SELECT n AS delivery_id, route, repo, CASE WHEN route <> 'ignored' THEN head_sha END AS sha, CASE WHEN route = 'index' THEN list_sort(['a', 'b' || n, 'c']) END AS paths FROM r""".replace("\\\\", "\\"),
    "request_guards": r"""SELECT delivery_id, coalesce(regexp_full_match(repo, '[\w.-]+/[\w.-]+') AND NOT contains(repo, '..'), FALSE) AS named,
  coalesce(list_sum(list_transform(map_values(head_files), lambda t: coalesce(length(t), 0))), 0) <= 20000 AS fits,
  list_filter(['static', 'reviewer', 'security', 'performance'], lambda a: coalesce(len(expected_agents), 0) = 0 OR coalesce(list_contains(expected_agents, a), FALSE)) AS agents FROM review_jobs""",
    "changed_head_files": """WITH p AS (SELECT job_id, list(DISTINCT path) AS paths FROM changed_files WHERE path IS NOT NULL GROUP BY 1)
SELECT delivery_id, len(list_filter(map_keys(head_files), lambda k: list_contains(paths, k))) AS n_files FROM review_jobs JOIN p USING (job_id) WHERE head_files IS NOT NULL""",
    "static_targets": "SELECT change_id, path FROM changed_files WHERE ends_with(path, '.py') AND coalesce(lower(trim(status)), '') <> 'removed'",
    "job_summaries": f"""WITH {_FAN}, {_CLEAN}, j AS (SELECT job_id, arg_min({{'repo': repo, 'title': title}}, (created_at, delivery_id)) AS j FROM review_jobs WHERE job_id IS NOT NULL GROUP BY 1),
d AS (SELECT job_id, count(*) AS expected, count(*) FILTER (status = 'ok') AS ok FROM st GROUP BY 1)
SELECT j.job_id, j.j.repo AS repo, j.j.title AS title, d.expected, d.ok, count(id) FILTER (severity = 'nitpick') AS nitpick, count(id) FILTER (severity = 'info') AS info, count(id) FILTER (severity = 'warning') AS warning, count(id) FILTER (severity = 'critical') AS critical
FROM j JOIN d USING (job_id) LEFT JOIN cf ON cf.job_id = j.job_id GROUP BY ALL""",
    "input_tokens_by_agent": "SELECT agent, time_bucket(INTERVAL 5 MINUTE, arrived_at, TIMESTAMP '1970-01-01') AS start, sum(coalesce(usage_stats.input_tokens, 0) + coalesce(usage_stats.cache_read_tokens, 0))::BIGINT AS n FROM agent_results WHERE arrived_at IS NOT NULL GROUP BY 1, 2",
    "tool_calls_by_window": "SELECT e.key AS tool, time_bucket(INTERVAL 5 MINUTE, arrived_at, TIMESTAMP '1970-01-01') AS start, sum(e.value)::BIGINT AS n FROM (SELECT arrived_at, unnest(map_entries(tool_calls)) AS e FROM agent_results WHERE arrived_at IS NOT NULL) GROUP BY 1, 2",
    "results_by_outcome": "SELECT CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS outcome, time_bucket(INTERVAL 5 MINUTE, arrived_at, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM agent_results WHERE arrived_at IS NOT NULL GROUP BY 1, 2",
    "failures_24h": "SELECT count(*) FILTER (error IS NOT NULL AND arrived_at > (SELECT max(arrived_at) FROM agent_results) - INTERVAL 24 HOUR) AS n FROM agent_results",
    "value_p95_by_type": """WITH b AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE])::DOUBLE AS le), h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, 0.95 * max(n) OVER (PARTITION BY event_type) AS want FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - below) / greatest(n - below, 1) END, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS rn FROM w WHERE n >= want AND n > 0) WHERE rn = 1""",
    "hybrid_search": "WITH " + _TOK.format(key="chunk_id", text="text", table="chunks") + ",\n" + _TOK.format(key="chunk_id", text="text", table="(SELECT chunk_id, concat_ws(' ', symbol, path) AS text FROM chunks WHERE chunk_id % 100 = 0 AND text IS NOT NULL)").replace("idents", "qi").replace("parts AS", "qp AS").replace("FROM parts", "FROM qp").replace("toks", "qt").replace("tf AS", "qf AS") + """,
idf AS (SELECT token, ln(1 + ((SELECT count(*) FROM chunks WHERE text IS NOT NULL) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
s AS (SELECT q.key AS query, d.key AS item, round(sum((1 + ln(q.n)) * (1 + ln(d.n)) * idf), 5) AS score FROM qf q JOIN tf d USING (token) JOIN idf USING (token) GROUP BY 1, 2),
h AS (SELECT 'd' AS side, key, ('0x' || left(md5(token), 8))::BIGINT AS h, n FROM tf UNION ALL SELECT 'q', key, ('0x' || left(md5(token), 8))::BIGINT, n FROM qf),
v AS (SELECT side, key, h % 384 AS dim, sum(CASE WHEN (h >> 16) & 1 = 1 THEN -1.0 ELSE 1.0 END * (1 + ln(n))) AS value FROM h GROUP BY 1, 2, 3 HAVING value <> 0),
u AS (SELECT side, key, dim, value / sqrt(sum(value * value) OVER (PARTITION BY side, key)) AS value FROM v),
e AS (SELECT q.key AS query, d.key AS item, round(sum(q.value * d.value), 5) AS score FROM u q JOIN u d ON q.dim = d.dim AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s UNION ALL SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) FROM e),
f AS (SELECT query, item, round(sum(1.0 / (2 + rank - 1)), 9) AS score FROM r WHERE rank <= 20 GROUP BY 1, 2)
SELECT query, item, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS n FROM f) WHERE n <= 5""",
    "static_agent": f"""WITH {_LINES}, {_FILES}, a AS (SELECT DISTINCT job_id, file, new_line::INT AS line FROM dl JOIN cfl USING (change_id) WHERE kind = '+')
SELECT job_id, file, line, 'static' AS agent, CASE line % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'nitpick' WHEN 3 THEN 'warning' ELSE 'info' END AS severity,
  CASE line % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'maintainability' WHEN 3 THEN 'bug' ELSE 'performance' END AS category,
  ['E999', 'S602', 'F401', 'B006', 'PERF401'][line % 5 + 1] || ': made' AS title, 0.9::DOUBLE AS confidence FROM a WHERE line % 3 = 0 AND job_id IS NOT NULL""",
    # queries of other modules whose SQL needs the lines of patches
    "rule_scan": f"""WITH {_LINES}, {_ADDED}, r AS ({_RULES_SQL}) SELECT change_id, line, agent, title, severity, category FROM al JOIN r ON regexp_matches(text, pattern) AND (no = '' OR NOT contains(text, no))""",
    "test_gap_rule": f"""WITH {_LINES}, {_ADDED}, t AS (SELECT DISTINCT job_id FROM al WHERE contains(file, 'test')), g AS (SELECT job_id, file, line, regexp_extract(text, '^\\s*def (\\w+)\\(', 1) AS name FROM al)
SELECT job_id, file, line, 'No test for `' || name || '`' AS title FROM g WHERE name <> '' AND (job_id IS NULL OR job_id NOT IN (SELECT job_id FROM t WHERE job_id IS NOT NULL))""".replace("\\\\", "\\"),
    "inline_routing": f"""WITH {_LINES}, {_CLEAN}, {_FILES}, a AS (SELECT DISTINCT job_id, file, new_line::INT AS line FROM dl JOIN cfl USING (change_id) WHERE new_line IS NOT NULL)
SELECT severity, a.job_id IS NOT NULL AS inline, count(*) AS n FROM cf LEFT JOIN a USING (job_id, file, line) GROUP BY 1, 2""",
    "histogram_p95": """WITH b AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 'inf'::DOUBLE])::DOUBLE AS le), a AS (SELECT agent, duration_ms / 1000 AS s FROM agent_results WHERE duration_ms IS NOT NULL),
h AS (SELECT agent, le, count(*) FILTER (s <= le) AS n FROM a, b GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, 0.95 * max(n) OVER (PARTITION BY agent) AS want FROM h WINDOW o AS (PARTITION BY agent ORDER BY le))
SELECT agent, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - below) / greatest(n - below, 1) END, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY le) AS rn FROM w WHERE n >= want AND n > 0) WHERE rn = 1""",
}
