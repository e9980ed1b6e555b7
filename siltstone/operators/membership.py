"""Membership: exact tests by semi and anti joins, and a cuckoo filter for keys that must be tested away from their table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLOTS, MAX_KICKS, HASH_SEED = 4, 500, 0
#: Tasks that share the probes of a shard.
PARTS = 8


def contained(probe: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return probe.join(keys.select(key).distinct(), key, "left_semi")


def missing(probe: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return probe.join(keys.select(key), key, "left_anti")


def xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=HASH_SEED)


class CuckooFilter:
    """Buckets of four one-byte fingerprints. False positives are possible; a failed insert leaves the filter as it was, so there
    are no false negatives."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS < capacity:
            buckets *= 2
        self.mask, self.count, self.table = buckets - 1, 0, bytearray(buckets * SLOTS)

    def _places(self, data: bytes) -> tuple[int, int, int]:
        h = xxh64(data)
        fp = h % 255 + 1
        first = h >> 32 & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ xxh64(bytes([fp]))) & self.mask

    def _slot(self, bucket: int, fp: int) -> int:
        return self.table.find(fp, bucket * SLOTS, bucket * SLOTS + SLOTS)

    def lookup(self, data: bytes) -> bool:
        fp, a, b = self._places(data)
        return self._slot(a, fp) >= 0 or self._slot(b, fp) >= 0

    def insert(self, data: bytes) -> bool:
        fp, a, b = self._places(data)
        for bucket in (a, b):
            if (at := self._slot(bucket, 0)) >= 0:
                self.table[at] = fp
                self.count += 1
                return True
        undo, bucket = [], b if xxh64(data) & 1 else a
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (xxh64(data) >> 8) % SLOTS ^ kick % SLOTS
            undo.append((at, self.table[at]))
            fp, self.table[at] = self.table[at], fp
            bucket = self._other(bucket, fp)
            if (free := self._slot(bucket, 0)) >= 0:
                self.table[free] = fp
                self.count += 1
                return True
        for at, was in reversed(undo):
            self.table[at] = was
        return False

    def insert_unique(self, data: bytes) -> bool:
        return not self.lookup(data) and self.insert(data)

    def delete(self, data: bytes) -> bool:
        fp, a, b = self._places(data)
        for bucket in (a, b):
            if (at := self._slot(bucket, fp)) >= 0:
                self.table[at] = 0
                self.count -= 1
                return True
        return False

    def reset(self) -> None:
        self.table, self.count = bytearray(len(self.table)), 0

    def encode(self) -> bytes:
        return bytes(self.table)

    @classmethod
    def decode(cls, raw: bytes) -> CuckooFilter:
        n = len(raw) // SLOTS
        if not raw or len(raw) % SLOTS or n & n - 1:
            raise ValueError("not the bytes of a filter")
        out = cls(SLOTS)
        out.table, out.mask, out.count = bytearray(raw), n - 1, len(raw) - raw.count(0)
        return out


class ScalableCuckooFilter:
    """Filters that grow: a new one, larger by scale, is added once the last is loaded beyond load of its slots or refuses a key."""

    def __init__(self, capacity: int = 10_000, load: float = 0.9, scale: int = 4):
        self.load, self.scale, self.filters = load, scale, [CuckooFilter(capacity)]

    def lookup(self, data: bytes) -> bool:
        return any(f.lookup(data) for f in self.filters)

    def insert(self, data: bytes) -> bool:
        last = self.filters[-1]
        if last.count < self.load * len(last.table) and last.insert(data):
            return True
        self.filters.append(CuckooFilter(len(last.table) * self.scale))
        return self.filters[-1].insert(data)

    def insert_unique(self, data: bytes) -> bool:
        return not self.lookup(data) and self.insert(data)

    def delete(self, data: bytes) -> bool:
        return any(f.delete(data) for f in self.filters)

    def reset(self) -> None:
        self.filters = self.filters[:1]
        self.filters[0].reset()

    @property
    def count(self) -> int:
        return sum(f.count for f in self.filters)

    def encode(self) -> list[bytes]:
        return [f.encode() for f in self.filters]

    @classmethod
    def decode(cls, raw: list[bytes], load: float = 0.9, scale: int = 4) -> ScalableCuckooFilter:
        out = cls(SLOTS, load, scale)
        out.filters = [CuckooFilter.decode(r) for r in raw]
        return out


def build_filters(keys: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """shard, filters (array of binary): a scalable filter for each of a number of shards of keys dealt by hash, so no task sees all."""
    dealt = keys.select(F.col(key).cast("binary").alias("k")).distinct().withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = ScalableCuckooFilter(max(SLOTS, len(pdf) * 8 // 7))
        for k in pdf["k"]:
            f.insert(bytes(k))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filters": [f.encode()]})

    return dealt.groupBy("shard").applyInPandas(build, "shard int, filters array<binary>")


def probe_filters(probe: DataFrame, filters: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """probe with maybe: false where the key is surely in no shard's filter. A shard's filters go once to each of the PARTS tasks
    that share its rows, ahead of the rows, which pass by them in batches; so no row carries a filter and no task holds a shard's rows."""
    whole = probe.select(F.pmod(F.xxhash64(F.col(key).cast("binary")), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("binary").alias("k"), F.struct(*probe.columns).alias("row"))
    spread = [c for c, kind in probe.dtypes if "map<" not in kind and "variant" not in kind]  # rows of a common key go to different parts, where they differ
    asked = whole.withColumn("part", F.pmod(F.xxhash64(*[F.col("row")[c] for c in spread]), F.lit(PARTS)).cast("int")).withColumn("asks", F.lit(True)).withColumn("filters", F.lit(None).cast("array<binary>"))
    held = filters.select("shard", "filters", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(False).alias("asks"), F.lit(None).cast("binary").alias("k"), F.lit(None).cast(probe.schema).alias("row"))
    met = held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, []
        for batch in batches:
            maybe = []
            for shard, part, asks, k, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "asks", "k", "filters"))):
                if (shard, part) != here:
                    here, known = (shard, part), []
                if asks:
                    maybe.append(k is not None and any(f.lookup(k) for f in known))
                else:
                    known.append(ScalableCuckooFilter.decode(raw))
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(batch.column("asks")), pa.array(maybe, pa.bool_())], ["row", "maybe"])

    return met.mapInArrow(look, StructType().add("row", probe.schema).add("maybe", "boolean")).select("row.*", "maybe")
