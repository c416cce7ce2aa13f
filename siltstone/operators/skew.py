"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: int = 64) -> list:
    """Keys of ``df`` that hold more than 1/``share`` of its rows.

    There can be at most ``share - 1`` of them, so what reaches the driver has
    a fixed bound. Counting combines before the shuffle.
    """
    total = df.count()
    if total < share * 1000:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return [r[0] for r in counts.where(F.col("__n") > total // share).select(key).take(share)]


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", share: int = 64, hot: list | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per ``key``.

    Rows of hot keys meet a broadcast of at most ``share - 1`` lookup rows;
    everything else is an ordinary shuffle join, in which no key holds more
    than 1/``share`` of the rows. NULL keys match nothing; a left join keeps
    them without shuffling them, so they don't meet in one task either.
    ``hot`` are the hot keys where the caller knows them.
    """
    hot = hot_keys(rows, key, share) if hot is None else hot
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = rows.where(F.col(key).isNotNull() & ~is_hot).join(lookup.where(~is_hot), key, how)
    if hot:
        out = out.unionByName(rows.where(is_hot).join(F.broadcast(lookup.where(is_hot)), key, how))
    if how != "left":
        return out
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name != key]
    return out.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
