"""The test tables as the engine's inputs: a change log, a write-ahead log, tables of sorted keys, manifest changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import DELETE, INSERT, READ, UPDATE

#: How long each write of an event of even id lives, the time "now" is, the tables' and blocks' sizes.
TTL_DAYS, NOW = 30, "2024-01-20 00:00:00"
TABLE_KEYS, BLOCK_BYTES, SEGMENT_BYTES = 500, 10_000, 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as key (user), value, op, commit_ts, seq, expires_at: sign-ups insert, clicks and purchases update, errors delete."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", INSERT).when(kind == "error", DELETE).when(kind == "view", READ).otherwise(UPDATE)
    expiry = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr(f"INTERVAL {TTL_DAYS} DAYS"))
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), op.alias("op"), F.col("ts").alias("commit_ts"), F.col("event_id").alias("seq"), expiry.alias("expires_at"))


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log records idx, data, size."""
    e = read(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("idx"), F.col("props").alias("data"), (F.octet_length("props") + 8).cast("long").alias("size"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as rows key, size, table_id, level of sorted tables of TABLE_KEYS keys: level by table."""
    o = read(spark, sf_dir, "orders")
    table = F.floor(F.col("o_orderkey") / TABLE_KEYS)
    return o.select(F.col("o_orderkey").alias("key"), (F.octet_length("o_orderpriority") + 16).cast("long").alias("size"), table.alias("table_id"), F.when(table % 5 == 0, 0).when(table % 5 == 1, 1).otherwise(2).alias("level"))


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of a manifest: sign-ups create a table, errors delete it."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select(F.floor(F.col("event_id") / 10).alias("change_set"), (F.col("event_id") % 10).cast("int").alias("pos"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "signup", "CREATE").otherwise("DELETE").alias("op"), (F.col("user_id") % 3).cast("int").alias("level"))
