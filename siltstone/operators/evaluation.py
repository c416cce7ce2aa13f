"""Scores of findings against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 3


def match_expected(findings: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """``case, expected_id, id`` of findings (case, id, file, line) within SLACK lines of an expected range (case, expected_id, file, first, last)."""
    near = F.col("line").between(F.col("first") - SLACK, F.col("last") + SLACK)
    return findings.join(expected, [case, "file"]).where(near).select(case, "expected_id", "id").distinct()


def score_cases(findings: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """``case, expected, hit, defects, true, other`` per case; findings of testing or nitpicks are no defects."""
    defect = (F.col("category") != "testing") & (F.col("severity") != "nitpick")
    hits = match_expected(findings.where(defect), expected, case)
    per_case = hits.groupBy(case).agg(F.count_distinct("expected_id").alias("hit"), F.count_distinct("id").alias("true"))
    found = findings.groupBy(case).agg(F.count_if(defect).alias("defects"), F.count_if(~defect).alias("other"))
    wanted = expected.groupBy(case).agg(F.count_distinct("expected_id").alias("expected"))
    joined = wanted.join(found, case, "full").join(per_case, case, "left")
    return joined.na.fill(0, ["expected", "hit", "defects", "true", "other"])


def summarize(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1; precision is 1 without defects, recall 1 with nothing expected."""
    sums = scores.groupBy(*(by or [])).agg(
        F.sum("expected").alias("expected"), F.sum("hit").alias("hit"), F.sum("defects").alias("defects"), F.sum("true").alias("true"),
        F.sum(F.when(F.col("expected") == 0, F.col("defects")).otherwise(0)).alias("clean_false"),
    )
    p = F.when(F.col("defects") == 0, 1.0).otherwise(F.col("true") / F.col("defects"))
    r = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hit") / F.col("expected"))
    return sums.withColumn("precision", F.bround(p, 6)).withColumn("recall", F.bround(r, 6)).withColumn(
        "f1", F.bround(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6)
    )


# Prices of a million tokens of a large, a medium and a small model: input, output, cache read, cache write.
PRICES = [("large", 4.0, 20.0, 0.20, 5.0), ("medium", 2.0, 10.0, 0.20, 2.5), ("small", 1.0, 5.0, 0.10, 1.25)]


def cost(usage: DataFrame, prices: DataFrame, default: str | None = None) -> DataFrame:
    """Usage (model, input, output, cache_read, cache_write tokens) with ``usd``.

    An unknown or NULL model costs what ``default`` does, else the dearest by
    output price. Where ``usage`` has ``billable``, rows of FALSE cost 0.
    ``prices`` has a row per model, a table of fixed size.
    """
    default = default or prices.orderBy(F.desc("output_price"), "model").first()["model"]
    known = usage.join(F.broadcast(prices.select("model").withColumn("priced", F.lit(True))), "model", "left")
    named = known.withColumn("model", F.when(F.col("priced"), F.col("model")).otherwise(default)).drop("priced")
    kinds = ["input", "output", "cache_read", "cache_write"]
    total = sum((F.col(f"{k}_tokens") * F.col(f"{k}_price") for k in kinds), F.lit(0.0)) / 1_000_000
    if "billable" in usage.columns:
        total = F.when(F.coalesce("billable", F.lit(True)), total).otherwise(0.0)
    return named.join(F.broadcast(prices), "model").withColumn("usd", total)
