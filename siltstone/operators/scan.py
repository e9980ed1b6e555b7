"""Ordered access: ranges, prefixes, neighbours and running positions of keys, which compare as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_scan(df: DataFrame, lo=None, hi=None, key: str = "key") -> DataFrame:
    """Keys from lo up to but not hi, in order; both comparisons are pushed to the scan."""
    for bound, test in ((lo, lambda c: c >= F.lit(lo)), (hi, lambda c: c < F.lit(hi))):
        if bound is not None:
            df = df.filter(test(F.col(key)))
    return df.orderBy(key)


def prefix_scan(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return df.filter(F.col(key).startswith(prefix)).orderBy(key)


def seek_before(df: DataFrame, key_value, key: str = "key") -> DataFrame:
    """The greatest key below a key, as one row; none if there is none."""
    return df.filter(F.col(key) < F.lit(key_value)).agg(F.max(key).alias(key)).filter(F.col(key).isNotNull())


def neighbours(df: DataFrame, key: str = "key", prefix_chars: int = 2) -> DataFrame:
    """Each distinct key with the one before and after it, without sorting all keys in one task.

    Keys are ordered within buckets of a common prefix; a bucket's ends meet the nearest ends of the other buckets, of which
    there are as many as distinct prefixes, in a second ordering. Longer prefixes suit more keys.
    """
    keys = df.select(key).distinct().withColumn("_b", F.substring(F.col(key), 1, prefix_chars))
    ends = keys.groupBy("_b").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    order = Window.orderBy("_b")
    around = ends.select("_b", F.lag("_hi").over(order).alias("_below"), F.lead("_lo").over(order).alias("_above"))
    within = Window.partitionBy("_b").orderBy(key)
    near = keys.withColumns({"_prev": F.lag(key).over(within), "_next": F.lead(key).over(within)})
    return near.join(around, "_b").select(key, F.coalesce("_prev", "_below").alias("prev_key"), F.coalesce("_next", "_above").alias("next_key"))


def positions(df: DataFrame, key: str = "key", prefix_chars: int = 2) -> DataFrame:
    """Each distinct key with its position in the order of all, from 1: its place in the bucket of its prefix, after the keys
    of the buckets before, of which there is one row each."""
    keys = df.select(key).distinct().withColumn("_b", F.substring(F.col(key), 1, prefix_chars))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keys.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(before, F.lit(0)).alias("_offset"))
    own = keys.withColumn("_own", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return own.join(offsets, "_b").select(key, (F.col("_offset") + F.col("_own")).cast("long").alias("position"))


def running_sum(df: DataFrame, order: str, value: str, into: str, width: int) -> DataFrame:
    """Adds the sum of value over rows before each, in order of an integral column without ties.

    Rows are summed within ranges of width values of order; the ranges' totals, one row each, are summed in turn and joined.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_range", before.alias("_offset"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(offsets, "_range").withColumn(into, F.col("_offset") + F.col("_own")).drop("_range", "_own", "_offset")


def with_previous(df: DataFrame, order: str, into: str, width: int) -> DataFrame:
    """Adds the preceding value of an integral column over all rows, found within ranges and from the ranges before."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    ends = ranged.groupBy("_range").agg(F.max(order).alias("_hi"))
    below = ends.select("_range", F.lag("_hi").over(Window.orderBy("_range")).alias("_below"))
    own = F.lag(order).over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_own", own).join(below, "_range").withColumn(into, F.coalesce("_own", "_below")).drop("_range", "_own", "_below")


def newest(df: DataFrame, n: int, order: str) -> DataFrame:
    """First-in-first-out retention: the last n rows by order, by a top-n of each partition."""
    return df.orderBy(F.col(order).desc()).limit(n)
