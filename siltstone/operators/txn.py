"""Transactions and request sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import TooBigError
from siltstone.functions.columns import DELETE, INSERT, READ, UPDATE, entry_size


class Transaction:
    """Operations buffered on the driver and published as one batch. There is no rollback, isolation or conflict detection."""

    def __init__(self, engine, txn_id: int):
        self.engine, self.txn_id, self._entries = engine, txn_id, []

    def add(self, op: int, key: bytes, value: bytes | None = None) -> None:
        """Inserts and updates write the value, deletes ignore it, reads are dropped, other codes are an error."""
        if op not in (INSERT, UPDATE, DELETE, READ):
            raise ValueError(f"unknown operation {op}")
        if op != READ:
            self._entries.append((key, None if op == DELETE else value or b"", op))

    def commit(self) -> int | None:
        """Publishes the buffer, in order, and empties it; the batch's id, or None if it is empty."""
        entries, self._entries = self._entries, []
        return self.engine.write(entries, txn_id=self.txn_id) if entries else None


def guard(entries: list[tuple], limit: int) -> None:
    """Raises TooBigError if a request has limit bytes or more."""
    size = sum(len(k) + len(v or b"") + 8 for k, v, *_ in entries)
    if size >= limit:
        raise TooBigError(f"request of {size} bytes; the limit is {limit}")


def batch_sizes(df: DataFrame, batch: str, key: str = "key", value: str = "value") -> DataFrame:
    """Entries and bytes of each batch."""
    return df.groupBy(batch).agg(F.count("*").alias("entries"), F.sum(entry_size(F.col(key), F.col(value))).alias("bytes"))


def too_big(sizes: DataFrame, limit: int) -> DataFrame:
    return sizes.withColumn("too_big", F.col("bytes") >= limit)
