"""Problem 6: the best representative of each group of duplicate findings.

Fields come from iterative truth discovery: a value's support is the summed
reliability of the agents that claim it, an agent's reliability the mean share
of support its claims get, repeated until no reliability moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.neardup import NEAR_SQL, near_findings
from siltstone.operators.components import connected_components
from siltstone.operators.skew import lookup_join
from siltstone.session import stage, unstage
from siltstone.sources.tables import table

# Severities, highest first.
SEVERITIES = ["critical", "warning", "info", "nitpick"]
MAX_ROUNDS, SETTLED = 60, 1e-3
FIELDS = ["severity", "category", "suggestion"]


def severity_of(col: str = "severity"):
    s = F.lower(F.trim(F.regexp_replace(F.col(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.when(s.isin(SEVERITIES), s).otherwise(F.lit("info"))


def severity_rank(col: str = "severity"):
    ranks = F.create_map(*[x for i, s in enumerate(reversed(SEVERITIES)) for x in (F.lit(s), F.lit(i))])
    return ranks[F.col(col)]


def confidence_of(col: str = "confidence"):
    c = F.col(col)
    known = c.isNotNull() & ~F.isnan(c) & (c != 0)
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.5))


def discover_truth(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(support, reliability)`` of ``claims`` (grp, field, value, source).

    ``support`` has grp, field, value and its summed reliability, ``reliability``
    source and its weight. Claims said more than once by a source count once.
    Reliabilities that have not settled after ``MAX_ROUNDS`` are an error.
    """
    claims = stage(claims.where("value is not null and source is not null").distinct(), "claims")
    trust = stage(claims.select("source").distinct().withColumn("trust", F.lit(0.8)), "trust")
    for _ in range(MAX_ROUNDS):
        weighted = lookup_join(claims, trust, "source")
        votes = weighted.groupBy("grp", "field", "value").agg(F.sum("trust").alias("support"))
        totals = votes.groupBy("grp", "field").agg(F.sum("support").alias("total"))
        share = votes.join(totals, ["grp", "field"]).withColumn("share", F.col("support") / F.col("total"))
        new = (
            claims.join(share, ["grp", "field", "value"])
            .groupBy("source")
            # two claims of trust 1/2 stand for what is not known yet
            .agg(((F.sum("share") + 1.0) / (F.count("*") + 2.0)).alias("new"))
        )
        moved = stage(trust.join(new, "source"), "trust")
        change = moved.agg(F.max(F.abs(F.col("new") - F.col("trust")))).first()[0]
        unstage(trust)
        trust = moved.select("source", F.col("new").alias("trust"))
        if change is None or change < SETTLED:
            break
    else:
        raise RuntimeError(f"reliabilities did not settle in {MAX_ROUNDS} rounds")
    support = lookup_join(claims, trust, "source").groupBy("grp", "field", "value").agg(F.sum("trust").alias("support"))
    return support, trust


def best_representatives(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per group: the surviving finding's id and its fused fields.

    Groups are the connected findings of ``pairs`` (id_a, id_b). The survivor
    has the highest severity, then the highest confidence, then the smallest
    id. ``severity, category, suggestion`` are the values of the highest
    support (ties: severity the higher, else the longer, then the smaller text);
    ``confidence`` is the survivor's, raised as 1-(1-c)*0.6^(agents-1);
    ``evidence`` and ``reported_by`` hold the distinct entries of all members,
    sorted. Findings in no pair are in no group; an empty table gives no rows.
    Equal ids count as one finding.
    """
    members = stage(connected_components(pairs, "id_a", "id_b").withColumnsRenamed({"node": "id", "component": "grp"}), "groups")
    cols = ["id", "agent", "severity", "category", "suggestion", "confidence", "evidence", "reported_by"]
    rows = stage(
        findings.select(*cols)
        .join(members, "id")
        .withColumn("severity", severity_of())
        .withColumn("confidence", confidence_of()),
        "members",
    )
    claims = rows.select(
        "grp",
        F.col("agent").alias("source"),
        F.explode(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.nullif(F.trim(F.col(f)), F.lit("")))])).alias("field", "value"),
    )
    support, _ = discover_truth(claims)
    weakness = F.struct(
        -F.round("support", 9),
        -F.coalesce(F.when(F.col("field") == "severity", severity_rank("value")), F.length("value")),
        F.col("value"),
    )
    best = support.groupBy("grp").pivot("field", FIELDS).agg(F.min_by("value", weakness))
    head = rows.groupBy("grp").agg(
        F.max_by("id", F.struct(severity_rank(), "confidence", F.lit(0))).alias("id"),
        F.max(F.struct(severity_rank(), "confidence")).alias("top"),
        F.count_distinct("id").alias("n_members"),
        F.count_distinct("agent").alias("n_agents"),
    )
    # the smallest id among equals
    first = (
        rows.select("grp", "id", F.struct(severity_rank(), "confidence").alias("top"))
        .join(head.select("grp", "top"), ["grp", "top"])
        .groupBy("grp")
        .agg(F.min("id").alias("id"))
    )
    lists = {
        name: rows.select("grp", F.explode(name).alias("x")).where("x is not null").distinct()
        .groupBy("grp").agg(F.array_sort(F.collect_list("x")).alias(name))
        for name in ("evidence", "reported_by")
    }
    raised = F.least(F.lit(1.0), 1 - (1 - F.col("top.confidence")) * F.pow(F.lit(0.6), F.greatest(F.col("n_agents") - 1, F.lit(0))))
    return (
        head.drop("id")
        .join(first, "grp")
        .join(best, "grp", "left")
        .join(lists["evidence"], "grp", "left")
        .join(lists["reported_by"], "grp", "left")
        .select("grp", "id", *FIELDS, raised.alias("confidence"), "evidence", "reported_by", "n_members", "n_agents")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_representatives(spark, sf_dir).select("id")


def p6_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "findings")
    return best_representatives(findings, near_findings(findings, links=True))


QUERIES = {"p6_found": p6_found, "p6_representatives": p6_representatives}
ORACLES = {
    "p6_found": NEAR_SQL
    + """,
e AS (SELECT id_a AS x, id_b AS y FROM near UNION SELECT id_b, id_a FROM near),
reach AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
grp AS (SELECT x AS id, min(y) AS grp FROM reach GROUP BY x),
v AS (
  SELECT g.grp, f.id,
    list_position(['nitpick', 'info', 'warning', 'critical'],
      CASE WHEN lower(trim(f.severity)) IN ('nitpick', 'info', 'warning', 'critical') THEN lower(trim(f.severity)) ELSE 'info' END) AS sev,
    CASE WHEN f.confidence IS NULL OR f.confidence = 0 THEN 0.5 ELSE greatest(0, least(1, f.confidence)) END AS c
  FROM grp g JOIN f ON f.id = g.id)
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY grp ORDER BY sev DESC, c DESC, id) AS rn FROM v) WHERE rn = 1"""
}
