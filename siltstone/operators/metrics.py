"""Operational metrics over event tables: rates, ratios, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds in seconds.
HANDLER_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300]
REVIEW_BUCKETS = [5, 10, 20, 30, 60, 90, 120, 180, 300, 600]


def windowed_count(events: DataFrame, ts: str, length: str, by: list[str], slide: str | None = None, value: Column | None = None) -> DataFrame:
    """``by, start, n`` per window; ``value`` is summed instead of rows counted."""
    at = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    return events.groupBy(*by, at.alias("w")).agg((F.sum(value) if value is not None else F.count("*")).alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def increase(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """Growth of counters between samples; after a reset the counter's value is its growth."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    return samples.withColumn("growth", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """``by, le, n``: cumulative counts at each bound and at infinity."""
    ends = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    first = rows.where(F.col(value).isNotNull()).select(*by, F.array_min(F.filter(ends, lambda b: F.col(value) <= b)).alias("le"))
    per = first.groupBy(*by, "le").agg(F.count("*").alias("n"))
    grid = per.select(*by).distinct().select(*by, F.explode(ends).alias("le"))
    full = grid.join(per, [*by, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumn("n", F.sum("n").over(upto))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """``by, value``: the quantile by straight lines within cumulative buckets; beyond the last bound, that bound."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rows = rows.withColumn("want", q * F.max("n").over(Window.partitionBy(*by))).where((F.col("n") >= F.col("want")) & (F.col("n") > 0))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / F.greatest(F.col("n") - F.col("below"), F.lit(1))
    hit = F.min(F.struct("le", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value")))
    return rows.groupBy(*by).agg(hit.alias("h")).select(*by, "h.value")


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1), nothing counting as zero."""
    return F.coalesce(part, F.lit(0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1))


def desired_replicas(lag: Column, threshold: int, most: int = 6) -> Column:
    """Replicas for a consumer lag: one per ``threshold`` messages, 1 to ``most``."""
    return F.greatest(F.least(F.ceil(lag / threshold), F.lit(most)), F.lit(1))
