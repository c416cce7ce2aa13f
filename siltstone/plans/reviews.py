"""Finding, fan-in, evaluation and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import hmac_sha256, job_of_message, signed_by, uuid5
from siltstone.operators import diffs, evaluation, findings, metrics
from siltstone.sources.tables import table

AGENTS = ["static", "reviewer", "security", "performance"]


def _clean(spark, d):
    return findings.sanitize(table(spark, d, "findings"))


def sanitize_findings(spark, d):
    return _clean(spark, d).select("id", "file", "line", "end_line", "severity", "category", F.round("confidence", 9).alias("confidence"), "suggestion", F.size("evidence").alias("n_evidence"))


def _added(spark, d):
    files = table(spark, d, "changed_files").select("change_id", "job_id", F.col("path").alias("file"))
    return diffs.patch_lines(table(spark, d, "changed_files"), "change_id").where("kind = '+'").join(files, "change_id")


def rule_scan(spark, d):
    return findings.scan_rules(_added(spark, d), ["change_id"]).select("change_id", "line", "agent", "title", "severity", "category")


def rule_scan_documents(spark, d):
    """Rules over every line of the corpus."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("new_line", "text"))
    return findings.scan_rules(lines, ["doc_id"]).groupBy("title", "severity").agg(F.count("*").alias("n"))


def test_gap_rule(spark, d):
    return findings.scan_test_gaps(_added(spark, d), "job_id").select("job_id", "file", "line", "title")


def classify_codes(spark, d):
    code = F.concat(F.element_at(F.array(*map(F.lit, ["E9", "F821", "S60", "S10", "S99", "F401", "B0", "BLE", "ASYNC", "PERF", "W"])), (F.col("p_partkey") % 11 + 1).cast("int")), (F.col("p_size") % 10).cast("string"))
    sev, cat = findings.classify_code(F.col("code"))
    return table(spark, d, "part").select("p_partkey", code.alias("code")).select("p_partkey", sev.alias("severity"), cat.alias("category"))


def greedy_cluster_text(spark, d):
    return findings.greedy_clusters(_clean(spark, d)).select("job_id", "file", "id", "line", "severity", "members", F.round("confidence", 6).alias("confidence"), "reported_by", "suggestion")


def consensus_confidence(spark, d):
    by_issue = _clean(spark, d).groupBy("repo", "file", "category").agg(F.max("confidence").alias("c"), F.count_distinct("agent").alias("agents"), F.array_sort(F.collect_set("agent")).alias("reported_by"))
    return by_issue.select("repo", "file", "category", "agents", "reported_by", F.round(findings.consensus(F.col("c"), F.col("agents")), 6).alias("confidence"))


def _judged(spark, d):
    f = _clean(spark, d)
    j = f.select(
        "id", F.lit(1).alias("ordinal"), (F.length("title") % 3 > 0).alias("keep"), F.when(F.length("message") % 5 > 0, 0.8).otherwise(0.3).alias("confidence"),
        F.lit(None).cast("string").alias("severity"), F.lit("rule match").alias("reason"),
    )
    return findings.apply_judgments(f, j)


def judge_apply(spark, d):
    return _judged(spark, d).select("id", "kept", F.round("confidence", 6).alias("confidence"), "severity")


def verdict(spark, d):
    return findings.verdicts(_judged(spark, d))


def inline_routing(spark, d):
    files = table(spark, d, "changed_files").select("change_id", "job_id", F.regexp_replace("path", r"^(\./)+", "").alias("file"))
    at = diffs.patch_lines(table(spark, d, "changed_files"), "change_id").where("new_line is not null").join(files, "change_id").select("job_id", "file", F.col("new_line").alias("line"))
    return findings.route(_clean(spark, d), at, ["job_id", "file"]).groupBy("severity", "inline").agg(F.count("*").alias("n"))


def severity_pivot(spark, d):
    return findings.severity_pivot(_clean(spark, d), "job_id")


def latest_reviews(spark, d):
    """The latest jobs with what they hold; a top-k report."""
    jobs = table(spark, d, "review_jobs").groupBy("job_id").agg(F.max("created_at").alias("created_at"), F.min("repo").alias("repo")).where("job_id is not null")
    n = table(spark, d, "findings").groupBy("job_id").agg(F.count("*").alias("findings"))
    top = jobs.orderBy(F.desc("created_at"), "job_id").limit(20)
    return top.join(n, "job_id", "left").select("job_id", "repo", F.coalesce("findings", F.lit(0)).alias("findings"))


def fan_in_status(spark, d):
    jobs = table(spark, d, "review_jobs").where("job_id is not null")
    return findings.fan_in(table(spark, d, "agent_results"), jobs, AGENTS)


def fan_in_complete(spark, d):
    s = fan_in_status(spark, d)
    return s.groupBy("job_id").agg(F.count("*").alias("expected"), F.count_if(F.col("status") != "timeout").alias("have"), (F.count_if(F.col("status") == "timeout") == 0).alias("complete"))


def usage_rollup(spark, d):
    r = table(spark, d, "agent_results").dropDuplicates(["result_id"])
    cols = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "llm_calls"]
    return r.groupBy("agent").agg(F.count("*").alias("results"), *[F.coalesce(F.sum(f"usage_stats.{c}"), F.lit(0)).alias(c) for c in cols], F.count_if(F.col("error").isNotNull()).alias("errors"))


def cost_model(spark, d):
    prices = spark.createDataFrame(evaluation.PRICES, "model string, input_price double, output_price double, cache_read_price double, cache_write_price double")
    model = F.when(F.col("agent") == "security", "large").when(F.col("agent") == "reviewer", "medium").otherwise("unknown")
    u = usage_rollup(spark, d).withColumn("model", model)
    return evaluation.cost(u, prices).select("agent", F.round("usd", 6).alias("usd"))


def tool_calls(spark, d):
    return table(spark, d, "agent_results").select("agent", F.explode("tool_calls").alias("tool", "n")).groupBy("agent", "tool").agg(F.sum("n").alias("n"))


def _expected(spark, d):
    """Chunks with symbols as the ranges in which defects are expected."""
    c = table(spark, d, "chunks").where("symbol is not null and start_line is not null and end_line is not null")
    return c.select(F.col("repo").alias("case"), F.col("chunk_id").alias("expected_id"), F.regexp_replace("path", r"^(\./)+", "").alias("file"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))


def eval_score(spark, d):
    f = _clean(spark, d).withColumnRenamed("repo", "case")
    return evaluation.score_cases(f, _expected(spark, d), "case").withColumnsRenamed({"true": "n_true", "case": "case_id"})


def eval_summary(spark, d):
    f = _clean(spark, d).withColumnRenamed("repo", "case")
    return evaluation.summarize(evaluation.score_cases(f, _expected(spark, d), "case")).drop("true")


def eval_ablation(spark, d):
    """One summary per agent left alone, as for modes of a review."""
    f = _clean(spark, d).withColumnRenamed("repo", "case").where("agent is not null")
    agents = f.select("agent").distinct()
    wanted = _expected(spark, d).crossJoin(agents).withColumn("case", F.concat_ws("|", "agent", "case")).drop("agent")
    s = evaluation.score_cases(f.withColumn("case", F.concat_ws("|", "agent", "case")), wanted, "case")
    return evaluation.summarize(s.withColumn("agent", F.substring_index("case", "|", 1)), ["agent"]).drop("true")


def rate_5m_by_type(spark, d):
    return metrics.windowed_count(table(spark, d, "events"), "ts", "5 minutes", ["event_type"]).withColumn("per_minute", F.round(F.col("n") / 5, 6))


def rate_sliding(spark, d):
    return metrics.windowed_count(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "30 minutes")


def counter_increase(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    g = metrics.increase(e, ["event_type", "user_id"], "event_id", "value")
    return g.groupBy("event_type").agg(F.round(F.sum("growth"), 4).alias("growth"))


def p95_by_agent(spark, d):
    return table(spark, d, "agent_results").groupBy("agent").agg(F.round(F.percentile("duration_ms", 0.95), 6).alias("p95"), F.round(F.median("duration_ms"), 6).alias("p50"), F.max("duration_ms").alias("longest"))


def rejection_ratio(spark, d):
    j = _judged(spark, d).groupBy("agent").agg(F.count_if(~F.col("kept")).alias("dropped"), F.count("*").alias("all"))
    return j.select("agent", F.round(metrics.ratio(F.col("dropped"), F.col("all")), 6).alias("ratio"))


def cache_share(spark, d):
    u = usage_rollup(spark, d)
    return u.select("agent", F.round(metrics.ratio(F.col("cache_read_tokens"), F.col("cache_read_tokens") + F.col("input_tokens")), 6).alias("share"))


def _seconds(spark, d):
    return table(spark, d, "agent_results").select("agent", (F.col("duration_ms") / 1000).alias("seconds"))


def histogram_buckets(spark, d):
    h = metrics.histogram(_seconds(spark, d), ["agent"], "seconds", metrics.HANDLER_BUCKETS)
    return h.select("agent", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")).alias("le"), "n")


def histogram_p95(spark, d):
    h = metrics.histogram(_seconds(spark, d), ["agent"], "seconds", metrics.HANDLER_BUCKETS)
    return metrics.histogram_quantile(h, ["agent"], 0.95).select("agent", F.round("value", 6).alias("value"))


def findings_per_hour(spark, d):
    f = _clean(spark, d).select("id", "severity").join(table(spark, d, "findings").select("id", "reported_at"), "id")
    return metrics.windowed_count(f, "reported_at", "1 hour", ["severity"])


def review_latency(spark, d):
    jobs = table(spark, d, "review_jobs").where("job_id is not null").groupBy("job_id").agg(F.min("created_at").alias("at"))
    done = table(spark, d, "agent_results").groupBy("job_id").agg(F.max("arrived_at").alias("done"))
    s = jobs.join(done, "job_id").select((F.unix_micros("done") - F.unix_micros("at")).alias("us"))
    return s.agg(F.count("*").alias("reviews"), F.round(F.percentile("us", 0.95) / 1e6, 3).alias("p95"), F.round(F.max("us") / 1e6, 3).alias("longest"))


_KEY = "k"


def webhook_filter(spark, d):
    """Signature and routing of request messages made of the jobs; some are unsigned or signed with another key."""
    body = F.to_json(F.struct("job_id", "repo", "pr_number"))
    j = table(spark, d, "review_jobs").select("delivery_id", body.alias("body"))
    key = F.when(F.col("delivery_id") % 4 > 0, F.lit(_KEY)).otherwise(F.lit("other"))
    sent = F.when(F.col("delivery_id") % 9 > 0, F.concat(F.lit("sha256="), F.when(key == _KEY, hmac_sha256(_KEY.encode(), F.col("body"))).otherwise(hmac_sha256(b"other", F.col("body")))))
    return j.select("delivery_id", job_of_message(F.lit(None).cast("string"), F.col("body")).alias("job"), signed_by(sent, _KEY.encode(), F.col("body")).alias("signed"))


def point_ids(spark, d):
    name = F.concat_ws(":", "repo", "path", "start_line", "end_line", "kind")
    return table(spark, d, "chunks").select("chunk_id", uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("point_id"))


def dedupe_jobs(spark, d):
    """First delivery of each repo, number and head commit; those without a commit are all kept."""
    j = table(spark, d, "review_jobs")
    known = j.where("length(head_sha) > 0").groupBy("repo", "pr_number", "head_sha").agg(F.min("delivery_id").alias("delivery_id")).select("delivery_id")
    return known.unionByName(j.where("coalesce(length(head_sha), 0) = 0").select("delivery_id"))


def changed_path_union(spark, d):
    """Distinct changed paths per job, sorted; NULL where none."""
    f = table(spark, d, "changed_files").groupBy("job_id").agg(F.array_sort(F.collect_set("path")).alias("p"))
    return f.select("job_id", F.when(F.size("p") > 0, F.col("p")).alias("paths"))


def topk_per_group(spark, d):
    c = table(spark, d, "customer")
    return c.selectExpr("c_nationkey", "c_custkey", "c_acctbal", "row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn").where("rn <= 5")


def set_ops(spark, d):
    """Nations of customers or suppliers, of both, of customers alone."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, t: df.select(F.lit(t).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(c.exceptAll(s).distinct().join(s, "k", "left_anti"), "except"))


def semi_anti(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    key = o.select(F.col("o_custkey").alias("c_custkey"))
    return c.join(key, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("ordered")).unionByName(c.join(key, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("ordered")))


def incremental_index(spark, d):
    """Chunks after the files of one batch are read again: theirs replaced, all others kept."""
    changed = table(spark, d, "changed_files").select("repo", F.regexp_replace("path", r"^(\./)+", "").alias("path")).distinct()
    c = table(spark, d, "chunks").withColumn("path", F.regexp_replace("path", r"^(\./)+", ""))
    kept = c.join(changed, ["repo", "path"], "left_anti").select("repo", "path", F.lit("kept").alias("how"))
    new = table(spark, d, "documents").join(changed, ["repo", "path"], "left_semi").select("repo", "path", F.lit("new").alias("how")).distinct()
    return kept.unionByName(new).groupBy("repo", "how").agg(F.count("*").alias("n"))


_CLEAN = r"""
cf AS (SELECT id, job_id, repo, agent, regexp_replace(file, '^(\./)+', '') AS file, CASE WHEN line > 0 THEN line END AS line,
  CASE WHEN end_line >= CASE WHEN line > 0 THEN line END THEN end_line ELSE CASE WHEN line > 0 THEN line END END AS end_line,
  CASE WHEN lower(trim(severity)) IN ('nitpick', 'info', 'warning', 'critical') THEN lower(trim(severity)) ELSE 'info' END AS severity,
  CASE WHEN lower(trim(category)) IN ('bug', 'security', 'performance', 'style', 'testing', 'maintainability') THEN lower(trim(category)) ELSE 'bug' END AS category,
  title, message, nullif(suggestion, '') AS suggestion, greatest(0.0, least(1.0, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END)) AS confidence,
  coalesce(evidence, [])[1:6] AS evidence, coalesce(reported_by, []) AS reported_by FROM findings WHERE length(file) > 0)"""
_JUDGED = _CLEAN + """,
jd AS (SELECT *, agent = 'static' AND len(reported_by) <= 1 AS free, CASE WHEN length(message) % 5 > 0 THEN 0.8 ELSE 0.3 END AS jc FROM cf),
jf AS (SELECT id, job_id, agent, severity, CASE WHEN free THEN confidence ELSE jc END AS confidence, free OR (length(title) % 3 > 0 AND CASE WHEN free THEN confidence ELSE jc END >= 0.6) AS kept FROM jd)"""
_RULES_SQL = " UNION ALL ".join(
    "SELECT '{}' AS agent, '{}' AS pattern, '{}' AS no, '{}' AS title, '{}' AS severity, '{}' AS category".format(
        a, p.replace("(?!.*timeout)", "").replace("'", "''"), "timeout" if "(?!" in p else "", t.replace("'", "''"), s, c
    )
    for a, p, t, _, s, c in findings.RULES
)
_FAN = """
due AS (SELECT job_id, min(created_at) AS created_at, arg_min(CASE WHEN len(expected_agents) > 0 THEN expected_agents ELSE ['static', 'reviewer', 'security', 'performance'] END, created_at) AS expected FROM review_jobs WHERE job_id IS NOT NULL GROUP BY 1),
wanted AS (SELECT DISTINCT job_id, unnest(expected) AS agent FROM due),
have AS (SELECT r.job_id, r.agent, arg_min(CASE WHEN error IS NULL THEN 'ok' ELSE 'error: ' || left(error, 120) END, (arrived_at, result_id)) AS status FROM agent_results r JOIN due USING (job_id) WHERE arrived_at <= created_at + INTERVAL 300 SECOND GROUP BY 1, 2),
st AS (SELECT w.job_id, w.agent, coalesce(h.status, 'timeout') AS status FROM wanted w LEFT JOIN have h USING (job_id, agent))"""
_USE = """us AS (SELECT agent, count(*) AS results, coalesce(sum(usage_stats.input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(usage_stats.output_tokens), 0)::BIGINT AS output_tokens,
  coalesce(sum(usage_stats.cache_read_tokens), 0)::BIGINT AS cache_read_tokens, coalesce(sum(usage_stats.cache_write_tokens), 0)::BIGINT AS cache_write_tokens, coalesce(sum(usage_stats.llm_calls), 0)::BIGINT AS llm_calls,
  count(*) FILTER (error IS NOT NULL) AS errors FROM agent_results GROUP BY 1)"""
_EVAL = _CLEAN + r""",
ex AS (SELECT repo AS c, chunk_id AS expected_id, regexp_replace(path, '^(\./)+', '') AS file, start_line AS first, end_line AS last FROM chunks WHERE symbol IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
{keys}
m AS (SELECT DISTINCT f.c, e.expected_id, f.id FROM fk f JOIN ek e ON f.c = e.c AND f.file = e.file AND f.line BETWEEN e.first - 3 AND e.last + 3 WHERE f.category <> 'testing' AND f.severity <> 'nitpick'),
sc AS (SELECT coalesce(w.c, f.c) AS c, coalesce(w.expected, 0) AS expected, coalesce(p.hit, 0) AS hit, coalesce(f.defects, 0) AS defects, coalesce(p.t, 0) AS n_true, coalesce(f.other, 0) AS other
  FROM (SELECT c, count(DISTINCT expected_id) AS expected FROM ek GROUP BY 1) w
  FULL JOIN (SELECT c, count(*) FILTER (category <> 'testing' AND severity <> 'nitpick') AS defects, count(*) FILTER (NOT (category <> 'testing' AND severity <> 'nitpick')) AS other FROM fk GROUP BY 1) f ON w.c = f.c
  LEFT JOIN (SELECT c, count(DISTINCT expected_id) AS hit, count(DISTINCT id) AS t FROM m GROUP BY 1) p ON p.c = coalesce(w.c, f.c))"""
_PLAIN_KEYS = "fk AS (SELECT repo AS c, * FROM cf), ek AS (SELECT * FROM ex),"
_AGENT_KEYS = "fk AS (SELECT agent || '|' || repo AS c, * FROM cf WHERE agent IS NOT NULL), ek AS (SELECT a.agent || '|' || ex.c AS c, expected_id, file, first, last FROM ex, (SELECT DISTINCT agent FROM cf WHERE agent IS NOT NULL) a),"
_SUMMARY = """SELECT {by} sum(expected)::BIGINT AS expected, sum(hit)::BIGINT AS hit, sum(defects)::BIGINT AS defects, sum(CASE WHEN expected = 0 THEN defects ELSE 0 END)::BIGINT AS clean_false,
  round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT *, CASE WHEN sum(defects) OVER w = 0 THEN 1.0 ELSE sum(n_true) OVER w / sum(defects) OVER w END AS p, CASE WHEN sum(expected) OVER w = 0 THEN 1.0 ELSE sum(hit) OVER w / sum(expected) OVER w END AS r
  FROM (SELECT *, {agent} AS agent FROM sc) WINDOW w AS (PARTITION BY agent)) GROUP BY agent, p, r"""

QUERIES = {f.__name__: f for f in (
    sanitize_findings, rule_scan, rule_scan_documents, test_gap_rule, classify_codes, greedy_cluster_text, consensus_confidence, judge_apply, verdict, inline_routing, severity_pivot, latest_reviews,
    fan_in_status, fan_in_complete, usage_rollup, cost_model, tool_calls, eval_score, eval_summary, eval_ablation, rate_5m_by_type, rate_sliding, counter_increase, p95_by_agent, rejection_ratio, cache_share,
    histogram_buckets, histogram_p95, findings_per_hour, review_latency, webhook_filter, point_ids, dedupe_jobs, changed_path_union, topk_per_group, set_ops, semi_anti, incremental_index,
)}
ORACLES = {
    "sanitize_findings": f"WITH {_CLEAN} SELECT id, file, line, end_line, severity, category, round(confidence, 9) AS confidence, suggestion, len(evidence) AS n_evidence FROM cf",
    "rule_scan_documents": f"""WITH r AS ({_RULES_SQL}), l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT title, severity, count(*) AS n FROM l JOIN r ON regexp_matches(line, pattern) AND (no = '' OR NOT contains(line, no)) GROUP BY 1, 2""",
    "classify_codes": """WITH c AS (SELECT p_partkey, ['E9', 'F821', 'S60', 'S10', 'S99', 'F401', 'B0', 'BLE', 'ASYNC', 'PERF', 'W'][p_partkey % 11 + 1] || (p_size % 10) AS code FROM part)
SELECT p_partkey,
  CASE WHEN code LIKE 'E9%' OR code IN ('F821', 'F822', 'F823') THEN 'critical' WHEN code LIKE 'S%' THEN CASE WHEN code[2:3] IN ('60', '30', '50', '10') THEN 'critical' ELSE 'warning' END
    WHEN code LIKE 'F401%' OR code LIKE 'F841%' THEN 'nitpick' WHEN code LIKE 'B%' OR code LIKE 'F%' THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN code LIKE 'E9%' OR code IN ('F821', 'F822', 'F823') THEN 'bug' WHEN code LIKE 'S%' THEN 'security' WHEN code LIKE 'F401%' OR code LIKE 'F841%' THEN 'maintainability'
    WHEN code LIKE 'B%' OR code LIKE 'F%' THEN 'bug' WHEN code LIKE 'ASYNC%' OR code LIKE 'PERF%' THEN 'performance' ELSE 'style' END AS category FROM c""",
    "consensus_confidence": f"""WITH {_CLEAN} SELECT repo, file, category, count(DISTINCT agent) AS agents, list_sort(list(DISTINCT agent) FILTER (agent IS NOT NULL)) AS reported_by,
  round(CASE WHEN count(DISTINCT agent) > 1 THEN least(1.0, 1 - (1 - max(confidence)) * pow(0.6, count(DISTINCT agent) - 1)) ELSE max(confidence) END, 6) AS confidence FROM cf GROUP BY 1, 2, 3""",
    "judge_apply": f"WITH {_JUDGED} SELECT id, kept, round(confidence, 6) AS confidence, severity FROM jf",
    "verdict": f"""WITH {_JUDGED}, v AS (SELECT job_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, max(list_position(['nitpick', 'info', 'warning', 'critical'], severity)) FILTER (kept) AS top FROM jf GROUP BY 1)
SELECT job_id, CASE WHEN top IS NULL THEN 'approve' WHEN top = 4 THEN 'request_changes' ELSE 'comment' END AS verdict, kept, dropped FROM v""",
    "severity_pivot": f"WITH {_CLEAN} SELECT job_id, count(*) FILTER (severity = 'nitpick') AS nitpick, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') AS critical FROM cf GROUP BY 1",
    "latest_reviews": """WITH j AS (SELECT job_id, max(created_at) AS c, min(repo) AS repo FROM review_jobs WHERE job_id IS NOT NULL GROUP BY 1 ORDER BY c DESC, job_id LIMIT 20)
SELECT j.job_id, j.repo, count(f.id) AS findings FROM j LEFT JOIN findings f USING (job_id) GROUP BY 1, 2""",
    "fan_in_status": f"WITH {_FAN} SELECT * FROM st",
    "fan_in_complete": f"WITH {_FAN} SELECT job_id, count(*) AS expected, count(*) FILTER (status <> 'timeout') AS have, count(*) FILTER (status = 'timeout') = 0 AS complete FROM st GROUP BY 1",
    "usage_rollup": f"WITH {_USE} SELECT * FROM us",
    "cost_model": f"""WITH {_USE}, p(model, i, o, r, w) AS (VALUES ('large', 4.0, 20.0, 0.2, 5.0), ('medium', 2.0, 10.0, 0.2, 2.5), ('small', 1.0, 5.0, 0.1, 1.25))
SELECT agent, round((input_tokens * i::DOUBLE + output_tokens * o::DOUBLE + cache_read_tokens * r::DOUBLE + cache_write_tokens * w::DOUBLE) / 1000000, 6) AS usd
FROM us JOIN p ON p.model = CASE WHEN agent = 'security' THEN 'large' WHEN agent = 'reviewer' THEN 'medium' ELSE 'large' END""",
    "tool_calls": "SELECT agent, e.key AS tool, sum(e.value)::BIGINT AS n FROM (SELECT agent, unnest(map_entries(tool_calls)) AS e FROM agent_results) GROUP BY 1, 2",
    "eval_score": "WITH " + _EVAL.format(keys=_PLAIN_KEYS) + " SELECT c AS case_id, expected, hit, defects, n_true, other FROM sc",
    "eval_summary": "WITH " + _EVAL.format(keys=_PLAIN_KEYS) + _SUMMARY.format(by="", agent="1"),
    "eval_ablation": "WITH " + _EVAL.format(keys=_AGENT_KEYS) + _SUMMARY.format(by="agent,", agent="split_part(c, '|', 1)"),
    "rate_5m_by_type": "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(count(*) / 5, 6) AS per_minute FROM events GROUP BY 1, 2",
    "rate_sliding": """WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events)
SELECT event_type, start, count(*) AS n FROM (SELECT event_type, b AS start FROM e UNION ALL SELECT event_type, b - INTERVAL 30 MINUTE FROM e) GROUP BY 1, 2""",
    "counter_increase": """WITH g AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS b FROM events)
SELECT event_type, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END), 4) AS growth FROM g GROUP BY 1""",
    "p95_by_agent": "SELECT agent, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(median(duration_ms), 6) AS p50, max(duration_ms) AS longest FROM agent_results GROUP BY 1",
    "rejection_ratio": f"WITH {_JUDGED} SELECT agent, round(count(*) FILTER (NOT kept) / greatest(count(*), 1), 6) AS ratio FROM jf GROUP BY 1",
    "cache_share": f"WITH {_USE} SELECT agent, round(cache_read_tokens / greatest(cache_read_tokens + input_tokens, 1), 6) AS share FROM us",
    "histogram_buckets": """WITH b AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 1e9])::DOUBLE AS le), a AS (SELECT agent, duration_ms / 1000 AS s FROM agent_results WHERE duration_ms IS NOT NULL)
SELECT agent, le, count(*) FILTER (s <= le) AS n FROM a, b GROUP BY 1, 2""",
    "findings_per_hour": f"WITH {_CLEAN} SELECT c.severity, date_trunc('hour', f.reported_at) AS start, count(*) AS n FROM cf c JOIN findings f USING (id) GROUP BY 1, 2",
    "review_latency": """WITH j AS (SELECT job_id, min(created_at) AS a FROM review_jobs WHERE job_id IS NOT NULL GROUP BY 1), r AS (SELECT job_id, max(arrived_at) AS d FROM agent_results GROUP BY 1),
s AS (SELECT epoch_us(d) - epoch_us(a) AS us FROM j JOIN r USING (job_id)) SELECT count(*) AS reviews, round(quantile_cont(us, 0.95) / 1e6, 3) AS p95, round(max(us) / 1e6, 3) AS longest FROM s""",
    "webhook_filter": "SELECT delivery_id, job_id AS job, delivery_id % 4 > 0 AND delivery_id % 9 > 0 AS signed FROM review_jobs",
    "point_ids": r"""WITH h AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', repo, path, start_line, end_line, kind))) AS h FROM chunks)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "dedupe_jobs": "SELECT min(delivery_id) AS delivery_id FROM review_jobs WHERE length(head_sha) > 0 GROUP BY repo, pr_number, head_sha UNION ALL SELECT delivery_id FROM review_jobs WHERE coalesce(length(head_sha), 0) = 0",
    "changed_path_union": "SELECT job_id, list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)) AS paths FROM changed_files GROUP BY 1",
    "topk_per_group": "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5",
    "set_ops": """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""",
    "semi_anti": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer",
    "incremental_index": r"""WITH ch AS (SELECT DISTINCT repo, regexp_replace(path, '^(\./)+', '') AS path FROM changed_files), c AS (SELECT repo, regexp_replace(path, '^(\./)+', '') AS path FROM chunks),
a AS (SELECT repo, path, 'kept' AS how FROM c WHERE (repo, path) NOT IN (SELECT repo, path FROM ch) UNION ALL SELECT DISTINCT repo, path, 'new' FROM documents WHERE (repo, path) IN (SELECT repo, path FROM ch))
SELECT repo, how, count(*) AS n FROM a GROUP BY 1, 2""",
}
