"""Expiry: per-key time to live, remaining time, resettable timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import is_live


def expire(df: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    return df.filter(is_live(F.col(expires_at), now))


def remaining_micros(expires_at: Column, now: Column) -> Column:
    """Microseconds to expiry; null without one."""
    return F.timestamp_diff("MICROSECOND", now, expires_at)


def debounced(df: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Each key's timer runs: a trigger within the ttl restarts the timer, a later one starts another. Columns: key, first and last
    trigger, triggers, fires_at. One shuffle by key: two windows of one partitioning and order, and an aggregation by it."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(order), F.col(ts))
    started = df.select(key, ts).withColumn("_new", F.when(gap < ttl_seconds, 0).otherwise(1))
    runs = started.withColumn("_run", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "_run").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("triggers"))
    return out.select(key, "first_ts", "last_ts", "triggers", F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("last_ts")).alias("fires_at"))
