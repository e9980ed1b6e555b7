"""The key-value engine: batches of writes become sorted Parquet tables in levels, published by a manifest.

A batch is visible once its change set is, as a whole. Reads take the newest version of each key over the tables whose key range may
hold it. Compaction merges tables of two neighbouring levels into new ones and swaps them in one change set; deletes are
dropped only where no deeper level can hold the key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ClosedError
from siltstone.functions.columns import DELETE, entry_size, is_live
from siltstone.operators import log as logs
from siltstone.operators import tables, txn
from siltstone.sources.manifest import CREATE, ManifestLog
from siltstone.sources.manifest import DELETE as DROP

SCHEMA = "key binary, value binary, op int, seq long, batch_id long, txn_id long, commit_ts timestamp, expires_at timestamp"


@dataclass(frozen=True)
class Options:
    """Sizes are bytes. Tables are written with a Parquet bloom filter on the key where bloom is set."""

    max_request: int = 64 << 20
    max_levels: int = 7
    level_zero_tables: int = 4
    base_level_size: int = 64 << 20
    level_size_multiplier: int = 10
    table_size: int = 64 << 20
    table_size_multiplier: int = 2
    memtable_size: int = 64 << 20
    max_deletions: int = 1000
    bloom: bool = True


class Engine:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):
        self.spark, self.root, self.options, self.closed = spark, root.rstrip("/"), options, False
        self.manifest = ManifestLog(spark, f"{self.root}/manifest", options.max_deletions)
        self._transactions = 0

    # reads

    def _check(self) -> None:
        if self.closed:
            raise ClosedError("the engine is closed")

    def _read(self, ids: list[int]) -> DataFrame:
        paths = [f"{self.root}/{self.manifest.state.tables[i]['path']}" for i in sorted(ids)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def log(self) -> DataFrame:
        """All versions that the tables hold."""
        self._check()
        return self._read(list(self.manifest.state.tables))

    def live(self, now: Column | None = None) -> DataFrame:
        return logs.live(self.log(), F.current_timestamp() if now is None else now).select("key", "value", "expires_at")

    def get(self, key: bytes, now: Column | None = None) -> bytes | None:
        """The live value of a key, or None. Tables whose range excludes the key are not read."""
        self._check()
        near = [i for i, t in self.manifest.state.tables.items() if t["lo"] <= key.hex() <= t["hi"]]
        row = logs.live(self._read(near).filter(F.col("key") == F.lit(bytearray(key))), F.current_timestamp() if now is None else now).first() if near else None
        return None if row is None else bytes(row["value"])

    def is_closed(self) -> bool:
        return self.closed

    # writes

    def begin(self) -> txn.Transaction:
        self._check()
        self._transactions += 1
        return txn.Transaction(self, self._transactions)

    def write(self, entries: list[tuple], txn_id: int | None = None, ttl_seconds: float | None = None) -> int:
        """Writes entries (key, value, op) in order as one batch and returns its id."""
        self._check()
        txn.guard(entries, self.options.max_request)
        rows = self.spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), op, i) for i, (k, v, op) in enumerate(entries)], "key binary, value binary, op int, pos long")
        expiry = F.lit(None).cast("timestamp") if ttl_seconds is None else F.timestamp_add("MICROSECOND", F.lit(int(ttl_seconds * 1e6)), F.current_timestamp())
        return self.append(rows.withColumn("expires_at", expiry), txn_id)

    def append(self, rows: DataFrame, txn_id: int | None = None, streams: dict[str, int] | None = None) -> int:
        """Appends rows (key, value, op, pos, expires_at) of any number as one batch; pos orders them within it. streams tells
        which micro-batch of which stream this is, so that it is known if it comes again. Each memtable_size bytes make a table."""
        self._check()
        batch = max((t["batch"] for t in self.manifest.state.tables.values()), default=0) + 1
        stamped = rows.select("key", "value", "op", (F.lit(batch << 32) + F.col("pos")).alias("seq"), F.lit(batch).cast("long").alias("batch_id"), F.lit(txn_id).cast("long").alias("txn_id"), F.current_timestamp().alias("commit_ts"), "expires_at")
        written = logs.writes(stamped)
        size = written.agg(F.sum(entry_size(F.col("key"), F.col("value")))).first()[0] or 0
        count = max(1, -(-size // self.options.memtable_size))
        self.manifest.add(self._write_tables(written, 0, batch, self.manifest.state.next_id(), count, streams or {}))
        return batch

    def streamed(self, name: str) -> int:
        """The last micro-batch of a stream that the tables hold, or -1."""
        return max((t.get("streams", {}).get(name, -1) for t in self.manifest.state.tables.values()), default=-1)

    def _write_tables(self, rows: DataFrame, level: int, batch: int, first_id: int, count: int, streams: dict[str, int]) -> list[dict]:
        """Writes rows as count tables of separate ranges and returns their CREATE changes. Files not published are invisible. Versions
        of a key may be parted by seq, so that no task gets all of a common key; tables of one version a key share no key."""
        place = f"level-{level}/{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(count, "key", "seq").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key", "seq")
        writer = ranged.write.partitionBy("part")
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(f"{self.root}/{place}")
        written = self.spark.read.schema(SCHEMA + ", part int").parquet(f"{self.root}/{place}")
        stats = tables.table_stats(written.withColumn("size", entry_size(F.col("key"), F.col("value"))), "part").orderBy("part").collect()  # one row a table
        return [{"op": CREATE, "id": first_id + i, "level": level, "path": f"{place}/part={s['part']}", "batch": batch, "lo": bytes(s["smallest"]).hex(), "hi": bytes(s["biggest"]).hex(), "rows": s["rows"], "bytes": s["bytes"], "streams": streams} for i, s in enumerate(stats)]

    # maintenance

    def _sizes(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for t in self.manifest.state.tables.values():
            out[t["level"]] = out.get(t["level"], 0) + t["bytes"]
        return out

    def plan(self) -> tuple[int, int, list[int]] | None:
        """The next compaction: level, level below, table ids; None if no level is over its target."""
        o, state = self.options, self.manifest.state
        sizes = self._sizes()
        t = tables.level_targets(sizes, o.max_levels, o.base_level_size, o.level_size_multiplier, o.table_size, o.table_size_multiplier, o.memtable_size)
        score = [len(state.level(0)) / o.level_zero_tables] + [sizes.get(n, 0) / max(1, t["targets"][n]) for n in range(1, o.max_levels)]
        after = lambda n: t["base"] if n == 0 else n + 1
        order = sorted((n for n in range(o.max_levels - 1) if score[n] >= 1), key=lambda n: -score[n] / max(0.01, score[after(n)] if after(n) < o.max_levels else 0.01))
        for n in order:
            top = state.level(0) if n == 0 else sorted(state.level(n), key=lambda i: state.tables[i]["lo"])[:1]
            if top:
                return n, after(n), top
        return None

    def compact(self) -> bool:
        """Runs the next compaction; False if there is none. The live view does not change."""
        self._check()
        planned = self.plan()
        if planned is None:
            return False
        level, below, top = planned
        state = self.manifest.state.tables
        lo, hi = min(state[i]["lo"] for i in top), max(state[i]["hi"] for i in top)
        met = [i for i, t in state.items() if t["level"] == below and t["lo"] <= hi and lo <= t["hi"]]
        merged = logs.latest(self._read([*top, *met]))
        deeper = any(t["level"] > below and t["lo"] <= hi and lo <= t["hi"] for t in state.values())
        if not deeper and not any(t["level"] <= level and i not in top and t["lo"] <= hi and lo <= t["hi"] for i, t in state.items()):
            # what is dropped here can't come back from elsewhere
            merged = merged.filter((F.col("op") != DELETE) & is_live(F.col("expires_at"), F.current_timestamp()))
        count = max(1, -(-sum(state[i]["bytes"] for i in (*top, *met)) // self.options.table_size))
        batch = max(state[i]["batch"] for i in (*top, *met))
        streams: dict[str, int] = {}
        for i in (*top, *met):
            for name, n in state[i].get("streams", {}).items():
                streams[name] = max(n, streams.get(name, -1))
        made = self._write_tables(merged, below, batch, self.manifest.state.next_id(), count, streams)
        self.manifest.add(made + [{"op": DROP, "id": i} for i in (*top, *met)])
        return True

    def close(self) -> None:
        """Ends the engine; a second call does nothing. Writes are durable once they return, so nothing waits."""
        self.closed = True
