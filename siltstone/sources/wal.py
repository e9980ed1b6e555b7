"""The write-ahead log: contiguous, 1-based records in segments, as a Parquet or JSON source and sink.

Records are rows (segment, idx, data). Segments are partition folders named by their first index, so a read of some indexes
prunes to their segments. Truncation rewrites only the segment that holds the new end and drops whole ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ClosedError, CorruptError, NotFoundError, OutOfOrderError, OutOfRangeError
from siltstone.operators.scan import running_sum, with_previous
from siltstone.sources import files

SCHEMA = "segment long, idx long, data binary"


def encode_json(idx: Column, data: Column) -> Column:
    """A record as a JSON line: UTF-8 data as "+text", other as "$" and URL-safe base64."""
    text = F.try_validate_utf8(data.cast("string"))
    coded = F.concat(F.lit("$"), F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_"))
    return F.to_json(F.struct(idx.cast("string").alias("index"), F.coalesce(F.concat(F.lit("+"), text), coded).alias("data")))


def decode_json(line: Column) -> Column:
    """struct<idx, data> of a JSON line; null fields where it can't be read."""
    r = F.from_json(line, "index string, data string")
    body = F.substring(r["data"], 2, 1 << 30)
    data = F.when(r["data"].startswith("+"), body.cast("binary")).when(r["data"].startswith("$"), F.unbase64(F.translate(body, "-_", "+/")))
    return F.struct(r["index"].try_cast("long").alias("idx"), data.alias("data"))


def segments(log: DataFrame, order: str, size: str, segment_bytes: int, width: int) -> DataFrame:
    """log with segment, the number of the segment that a record falls in: one closes once it has segment_bytes or more before a record."""
    return running_sum(log, order, size, "_before", width).withColumn("segment", F.floor(F.col("_before") / segment_bytes)).drop("_before")


def gaps(log: DataFrame, width: int, idx: str = "idx") -> DataFrame:
    """Where records are missing: the index after a gap and the last one before it."""
    return with_previous(log.select(idx), idx, "prev_idx", width).filter(F.col(idx) != F.col("prev_idx") + 1)


def bounds(log: DataFrame, idx: str = "idx") -> DataFrame:
    """first_idx and last_idx; 1 and 0 of an empty log."""
    return log.agg(F.coalesce(F.min(idx), F.lit(1)).cast("long").alias("first_idx"), F.coalesce(F.max(idx), F.lit(0)).cast("long").alias("last_idx"))


def truncate_front(log: DataFrame, at: int, idx: str = "idx") -> DataFrame:
    return log.filter(F.col(idx) >= at)


def truncate_back(log: DataFrame, at: int, idx: str = "idx") -> DataFrame:
    return log.filter(F.col(idx) <= at)


class Wal:
    """A log in a folder. A JSON file beside the segments says which are part of it, so a change of the log is one rename."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        if fmt not in ("parquet", "json"):
            raise ValueError(f"unknown log format {fmt}")
        self.spark, self.path, self.fmt, self.closed = spark, path, fmt, False
        files.mkdirs(spark, f"{path}/_catalog")
        found = [n for n in files.names(spark, f"{path}/_catalog") if n.endswith(".json")]
        self._version = int(found[-1][:-5]) if found else 0
        try:
            self._segments = json.loads(files.read(spark, f"{path}/_catalog/{found[-1]}")) if found else []
        except ValueError as e:
            raise CorruptError(path) from e

    def _check(self) -> None:
        if self.closed:
            raise ClosedError("the log is closed")

    def _publish(self, segments_now: list[dict]) -> None:
        if not files.create(self.spark, f"{self.path}/_catalog/{self._version + 1:020d}.json", json.dumps(segments_now)):
            raise OutOfOrderError("another writer changed the log")
        self._version, self._segments = self._version + 1, segments_now

    @property
    def first_index(self) -> int:
        return self._segments[0]["first"] if self._segments else 1

    @property
    def last_index(self) -> int:
        return self._segments[-1]["last"] if self._segments else 0

    def _store(self, rows: DataFrame, first: int, last: int) -> dict:
        name = f"{first:020d}-{self._version + 1}"
        if self.fmt == "json":
            rows.orderBy("idx").select(encode_json(F.col("idx"), F.col("data")).alias("value")).write.text(f"{self.path}/{name}")
        else:
            rows.select("idx", "data").sortWithinPartitions("idx").write.parquet(f"{self.path}/{name}")
        return {"first": first, "last": last, "name": name}

    def write_batch(self, records: list[tuple[int, bytes]]) -> None:
        """Appends records as one segment; their indexes must follow the last."""
        self._check()
        for at, (idx, _) in enumerate(records):
            if idx != self.last_index + 1 + at:
                raise OutOfOrderError(f"index {idx} after {self.last_index + at}")
        if records:
            rows = self.spark.createDataFrame(records, "idx long, data binary")
            self._publish([*self._segments, self._store(rows, records[0][0], records[-1][0])])

    def _load(self, found: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{s['name']}" for s in found]
        if not paths:
            return self.spark.createDataFrame([], "idx long, data binary")
        if self.fmt == "parquet":
            return self.spark.read.schema("idx long, data binary").parquet(*paths)
        return self.spark.read.text(paths).select(decode_json(F.col("value")).alias("r")).select("r.idx", "r.data")

    def records(self) -> DataFrame:
        self._check()
        return self._load(self._segments)

    def read(self, index: int) -> bytes:
        self._check()
        row = self._load([s for s in self._segments if s["first"] <= index <= s["last"]]).filter(F.col("idx") == index).first()
        if row is None:
            raise NotFoundError(f"no record {index}")
        if row["data"] is None:
            raise CorruptError(f"record {index}")
        return bytes(row["data"])

    def _range(self, index: int) -> None:
        self._check()
        if not self.first_index <= index <= self.last_index:
            raise OutOfRangeError(f"{index} is not in {self.first_index}..{self.last_index}")

    def truncate_front(self, index: int) -> None:
        """Drops the records before index."""
        self._range(index)
        keep = [s for s in self._segments if s["last"] >= index]
        if keep[0]["first"] < index:
            keep[0] = self._store(truncate_front(self._load(keep[:1]), index), index, keep[0]["last"])
        self._publish(keep)

    def truncate_back(self, index: int) -> None:
        """Drops the records after index."""
        self._range(index)
        keep = [s for s in self._segments if s["first"] <= index]
        if keep[-1]["last"] > index:
            keep[-1] = self._store(truncate_back(self._load(keep[-1:]), index), keep[-1]["first"], index)
        self._publish(keep)

    def close(self) -> None:
        self._check()
        self.closed = True
