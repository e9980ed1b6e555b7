"""Reads of a change log: last writer wins by (commit_ts, seq), deletes hide, reads are no writes.

All are one aggregation by key with partial aggregation before the shuffle, so a key with a third of all versions costs its
mappers' work and one row from each. Point and multi-key reads filter first, which reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.columns import DELETE, READ, is_live

VERSION = ("commit_ts", "seq")


def writes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") != READ)


def latest(log: DataFrame, keys: Sequence[str] = ("key",), version: Sequence[str] = VERSION) -> DataFrame:
    """The newest version of each key, deletes included. version must order the versions of a key without ties."""
    rest = [c for c in log.columns if c not in keys and c not in version]
    newest = F.max(F.struct(*version, *rest)).alias("_newest")
    return log.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in (*version, *rest)]).select(*log.columns)


def live(log: DataFrame, now: Column | None = None) -> DataFrame:
    """The live view: newest writes that are neither deletes nor expired at now. The newest write alone decides expiry."""
    newest = latest(writes(log)).filter(F.col("op") != DELETE)
    return newest if now is None else newest.filter(is_live(F.col("expires_at"), now))


def as_of(log: DataFrame, ts: Column) -> DataFrame:
    """The live view of the writes up to and including ts."""
    return live(log.filter(F.col("commit_ts") <= ts))


def get(log: DataFrame, *keys) -> DataFrame:
    """The live values of some keys; a missing key has no row, an empty value has one."""
    return live(log.filter(F.col("key").isin(*keys)))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The live values of the keys in a DataFrame of any size."""
    return live(log.join(wanted.select("key").distinct(), "key", "left_semi"))


def history(log: DataFrame) -> DataFrame:
    """Each write with the commit time of the next one to its key, which ends its validity."""
    from pyspark.sql import Window

    return writes(log).withColumn("valid_to", F.lead("commit_ts").over(Window.partitionBy("key").orderBy(*VERSION)))


def merge(*runs: DataFrame) -> DataFrame:
    """Sorted runs as one, the newest version of each key in key order within partitions."""
    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    return latest(union).sortWithinPartitions("key")
