"""Tables, blocks, levels and compaction planning over table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import overlaps
from siltstone.operators.scan import running_sum


def table_stats(rows: DataFrame, table: str = "table_id", key: str = "key", size: str = "size") -> DataFrame:
    """Smallest and biggest key, rows and bytes of each table."""
    return rows.groupBy(table).agg(F.min(key).alias("smallest"), F.max(key).alias("biggest"), F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of tables (left_id, right_id) of two levels whose key ranges share a key.

    Tables of a level below the first do not overlap, so each range meets few; ranges meet by equality on numbered slices of the
    key space where the caller has put a list column "slices" on both, and by comparison otherwise (small levels).
    """
    a = left.select(F.col("table_id").alias("left_id"), F.col("smallest").alias("_ls"), F.col("biggest").alias("_lb"), *(["slices"] if "slices" in left.columns else []))
    b = right.select(F.col("table_id").alias("right_id"), F.col("smallest").alias("_rs"), F.col("biggest").alias("_rb"), *(["slices"] if "slices" in right.columns else []))
    meet = overlaps(F.col("_ls"), F.col("_lb"), F.col("_rs"), F.col("_rb"))
    if "slices" in a.columns and "slices" in b.columns:
        pairs = a.select("left_id", "_ls", "_lb", F.explode("slices").alias("slice")).join(b.select("right_id", "_rs", "_rb", F.explode("slices").alias("slice")), "slice").filter(meet)
        return pairs.select("left_id", "right_id").distinct()
    return a.join(b, meet).select("left_id", "right_id")


def with_slices(stats: DataFrame, width: int) -> DataFrame:
    """Adds slices, the numbers of the width-wide slices of an integral key space that a table's range touches."""
    return stats.withColumn("slices", F.sequence(F.floor(F.col("smallest") / width), F.floor(F.col("biggest") / width)))


def block_index(rows: DataFrame, order: str, key: str, size: str, block_bytes: int, width: int) -> DataFrame:
    """Blocks of about block_bytes in key order: block, first_key, last_key, rows, bytes, offset. Block numbers come from the
    bytes before a row, so they are found without passing rows from task to task."""
    placed = running_sum(rows, order, size, "_before", width)
    blocks = placed.withColumn("block", F.floor(F.col("_before") / block_bytes)).groupBy("block")
    return blocks.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min("_before").alias("offset"))


def level_targets(sizes: dict[int, int], max_levels: int, base_size: int, size_multiplier: int, table_size: int, table_multiplier: int, memtable_size: int) -> dict:
    """Target bytes of each level, target file bytes of each level, and the level that the first one compacts into.

    From the last level's size upwards each level gets a share of the one below, base_size at least. The base level is the
    deepest whose target need not exceed base_size; with empty levels below it, the deepest of those that are empty.
    """
    size = sizes.get(max_levels - 1, 0)
    targets, base = [0] * max_levels, 0
    for level in range(max_levels - 1, 0, -1):
        targets[level] = max(size, base_size)
        if base == 0 and size <= base_size:
            base = level
        size //= size_multiplier
    files = [memtable_size if level == 0 else table_size * (table_multiplier ** max(0, level - base) if level >= base else 1) for level in range(max_levels)]
    base = base or 1
    while base + 1 < max_levels and sizes.get(base, 0) == 0 and sizes.get(base + 1, 0) == 0:
        base += 1
    return {"targets": targets, "file_sizes": files, "base": base}


def level_scores(stats: DataFrame, level_zero_tables: int) -> DataFrame:
    """level, tables, bytes, score: the first level's by its tables, the others' by bytes over target (column target)."""
    by = stats.groupBy("level").agg(F.count("*").alias("tables"), F.sum("bytes").alias("bytes"), F.max("target").alias("target"))
    score = F.when(F.col("level") == 0, F.col("tables") / F.lit(level_zero_tables)).otherwise(F.col("bytes") / F.col("target"))
    return by.select("level", "tables", "bytes", score.cast("double").alias("score"))


def compaction_priority(scores: DataFrame, base: int = 1) -> DataFrame:
    """Adds adjusted: a score of 1 or more is divided by the next level's (0.01 at least), so that a level waits while the one it
    would compact into is full. The first level's next is base. Rows are levels, so one task orders them all."""
    rows = scores.filter((F.col("level") == 0) | (F.col("level") >= base))
    following = F.coalesce(F.lead("score").over(Window.orderBy("level")), F.lit(0.0))
    return rows.withColumn("adjusted", F.when(F.col("score") >= 1, F.col("score") / F.greatest(following, F.lit(0.01))).otherwise(F.col("score")))
