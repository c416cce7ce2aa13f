"""Streaming queries: each runs to the end of its files and returns the final table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.reviews import _FAN, AGENTS
from siltstone.sources.tables import table
from siltstone.streaming import jobs


def stream_tumbling(spark, d):
    return jobs.run_to_table(jobs.windowed_counts(jobs.stream_table(spark, d, "events"), "ts", "event_type", "1 hour"), "complete")


def stream_sliding(spark, d):
    return jobs.run_to_table(jobs.windowed_counts(jobs.stream_table(spark, d, "events"), "ts", "event_type", "1 hour", "30 minutes"), "complete")


def stream_sessions(spark, d):
    return jobs.run_to_table(jobs.session_counts(jobs.stream_table(spark, d, "events"), "ts", "user_id", "30 minutes"), "complete")


def stream_dedupe(spark, d):
    """How many deliveries pass, per repository."""
    kept = jobs.run_to_table(jobs.dedupe_requests(jobs.stream_table(spark, d, "review_jobs")).select("delivery_id", "repo"))
    return kept.groupBy("repo").agg(F.count("*").alias("passed"))


def stream_fan_in(spark, d):
    """Jobs with what each expected agent came to, once all is in or the deadline passed."""
    return jobs.fan_in_table(spark, d, "review_jobs", "agent_results", AGENTS).select("job_id", "complete", "agents")


def stream_dlq(spark, d):
    """Event properties as messages; what is not a JSON object goes to the dead letters."""
    m = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 97 == 0, F.substring("props", 2, 100)).otherwise(F.col("props")).alias("value"))
    good, dead = jobs.with_dead_letters(m)
    tally = lambda x, n: x.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("outcome"), "n")
    return tally(good, "ok").unionByName(tally(dead, "dlq"))


def job_status(spark, d):
    j = table(spark, d, "review_jobs").where("job_id is not null").select("job_id", F.lit("queued").alias("status"))
    r = table(spark, d, "agent_results").select("job_id", F.lit("agents").alias("status"))
    f = table(spark, d, "findings").select("job_id", F.lit("judging").alias("status"))
    return jobs.latest_status(j.unionByName(r).unionByName(f))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedupe, stream_fan_in, stream_dlq, job_status)}
ORACLES = {
    "stream_tumbling": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": """WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events)
SELECT event_type, start, count(*) AS n FROM (SELECT event_type, b AS start FROM e UNION ALL SELECT event_type, b - INTERVAL 30 MINUTE FROM e) GROUP BY 1, 2""",
    "stream_sessions": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedupe": """WITH k AS (SELECT min(delivery_id) AS delivery_id FROM review_jobs WHERE length(head_sha) > 0 GROUP BY repo, pr_number, head_sha UNION ALL SELECT delivery_id FROM review_jobs WHERE coalesce(length(head_sha), 0) = 0)
SELECT repo, count(*) AS passed FROM review_jobs JOIN k USING (delivery_id) GROUP BY 1""",
    "stream_fan_in": f"""WITH {_FAN} SELECT job_id, count(*) FILTER (status = 'timeout') = 0 AS complete,
  '{{' || string_agg('"' || agent || '": ' || to_json(status)::VARCHAR, ', ' ORDER BY agent) || '}}' AS agents FROM st GROUP BY 1""",
    "stream_dlq": "SELECT CASE WHEN event_id % 97 = 0 THEN 'dlq' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "job_status": """WITH u AS (SELECT job_id, 1 AS o FROM review_jobs WHERE job_id IS NOT NULL UNION ALL SELECT job_id, 2 FROM agent_results UNION ALL SELECT job_id, 3 FROM findings)
SELECT job_id, ['queued', 'agents', 'judging'][max(o)] AS status FROM u GROUP BY 1""",
}
