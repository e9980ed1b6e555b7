"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        holder = tempfile.TemporaryDirectory(prefix="siltstone-")
        atexit.register(holder.cleanup)
        _own_dirs[app] = f"file://{holder.name}"
    return _own_dirs[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, and a lost executor costs a read only."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder, for when all results that read it are stored."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words(text: Column) -> Column:
    """The maximal runs of characters other than x20 and x09 to x0D; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Bounds the Arrow batches of plans made within by bytes, where the session sets no bound itself; long texts else make batches
    of 10,000 rows that no executor's memory is meant for."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(key, None) or "-1") in ("-1", str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set(key, most)
    yield


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n ascending values of an integral column that cut its rows into about equal ranges; exact counts do not depend on them."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * n))).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: Sequence[int]) -> Column:
    """How many bounds are at most key: a number that ascends with key, found by bisection."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    if len(bounds) <= 64:
        return between(0, len(bounds))
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= key))
