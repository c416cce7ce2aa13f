"""Problem 2: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.redelivery import assign_requests, superfluous_deliveries
from siltstone.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superfluous_deliveries(table(spark, sf_dir, "review_jobs"))


def p2_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery with its request and how often that request came."""
    got = assign_requests(table(spark, sf_dir, "review_jobs"))
    sizes = got.groupBy("request_id").agg(F.count("*").alias("n_deliveries"))
    return got.groupBy("request_id").agg(F.max("delivery_id").alias("last_delivery")).join(sizes, "request_id")


_CLOSED = r"""
WITH RECURSIVE base AS (
  SELECT delivery_id, repo, pr_number,
    regexp_replace(lower(job_id), 'urn:|uuid:|[\s{}()-]', '', 'g') AS j,
    regexp_replace(lower(head_sha), '\s', '', 'g') AS s
  FROM review_jobs WHERE delivery_id IS NOT NULL),
k AS (
  SELECT delivery_id, repo, pr_number,
    CASE WHEN regexp_full_match(j, '[0-9a-f]{32}') THEN j END AS job,
    CASE WHEN regexp_full_match(s, '[0-9a-f]{7,64}') AND NOT regexp_full_match(s, '0+') THEN s END AS sha
  FROM base),
e AS (
  SELECT a.delivery_id AS x, b.delivery_id AS y FROM k a JOIN k b ON a.job = b.job
  UNION
  SELECT a.delivery_id, b.delivery_id FROM k a JOIN k b
    ON a.repo = b.repo AND a.pr_number = b.pr_number AND left(a.sha, 7) = left(b.sha, 7)
    WHERE starts_with(a.sha, b.sha) OR starts_with(b.sha, a.sha)),
reach AS (
  SELECT delivery_id AS x, delivery_id AS y FROM k
  UNION
  SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
grp AS (SELECT x AS delivery_id, min(y) AS request_id FROM reach GROUP BY x)
"""

QUERIES = {"p2_found": p2_found, "p2_requests": p2_requests}
ORACLES = {
    "p2_found": _CLOSED + "SELECT delivery_id FROM grp WHERE delivery_id <> request_id",
    "p2_requests": _CLOSED
    + "SELECT request_id, max(delivery_id) AS last_delivery, count(*) AS n_deliveries FROM grp GROUP BY request_id",
}
