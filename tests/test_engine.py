"""The engine, its log, manifest, filters and streams, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions import columns as C
from siltstone.operators import log, membership, scan, tables, ttl
from siltstone.sources.manifest import Manifest, ManifestLog
from siltstone.sources.store import Engine, Options
from siltstone.sources.wal import Wal
from siltstone.streaming.ingest import expirations, ingest

SMALL = Options(level_zero_tables=2, base_level_size=100, table_size=200, max_request=1000, max_levels=4, level_size_multiplier=2)


def _view(engine):
    return {bytes(r["key"]): bytes(r["value"]) for r in engine.live().collect()}


def test_engine_round_trip(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", SMALL)
    assert e.get(b"a") is None
    e.write([(b"a", b"1", C.INSERT), (b"b", b"", C.INSERT), (b"a", b"2", C.UPDATE), (b"c", b"TOMBSTONE", C.INSERT), (b"\x80\xff", b"high", C.INSERT)])
    assert e.get(b"a") == b"2" and e.get(b"b") == b"" and e.get(b"c") == b"TOMBSTONE" and e.get(b"ab") is None and e.get(b"\x80\xff") == b"high"
    t = e.begin()
    t.add(C.DELETE, b"a", b"ignored")
    t.add(C.READ, b"b")
    t.add(C.DELETE, b"never there")
    t.add(C.UPDATE, b"b", b"new")
    assert e.get(b"a") == b"2"
    t.commit()
    assert e.get(b"a") is None and e.get(b"b") == b"new" and t.commit() is None
    with pytest.raises(ValueError):
        t.add(9, b"x")
    again = Engine(spark, f"file://{tmp_path}/db", SMALL)
    assert _view(again) == {b"b": b"new", b"c": b"TOMBSTONE", b"\x80\xff": b"high"}
    with pytest.raises(errors.TooBigError):
        e.write([(b"k", b"v" * 991, C.INSERT)])
    e.write([(b"k", b"v" * 990, C.INSERT)])
    e.close()
    e.close()
    assert e.is_closed()
    for call in (lambda: e.get(b"a"), lambda: e.write([]), e.begin):
        with pytest.raises(errors.ClosedError):
            call()


def test_compaction_keeps_the_view(spark, tmp_path):
    e, expected, rng = Engine(spark, f"file://{tmp_path}/db", SMALL), {}, random.Random(5)
    for _ in range(5):
        batch = []
        for _ in range(12):
            k, v, op = f"k{rng.randrange(15)}".encode(), str(rng.random()).encode(), rng.choice([C.INSERT, C.UPDATE, C.DELETE])
            batch.append((k, v, op))
            expected.pop(k, None) if op == C.DELETE else expected.__setitem__(k, v)
        e.write(batch)
        e.compact()
        assert _view(e) == expected
    for _ in range(6):
        if not e.compact():
            break
    assert _view(e) == expected and not e.manifest.state.level(0)[1:]
    for level in (1, 2, 3):
        spans = sorted((e.manifest.state.tables[i]["lo"], e.manifest.state.tables[i]["hi"]) for i in e.manifest.state.level(level))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_ttl(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", SMALL)
    e.write([(b"a", b"1", C.INSERT), (b"b", b"1", C.INSERT)], ttl_seconds=60)
    e.write([(b"b", b"2", C.UPDATE)])
    later = F.current_timestamp() + F.expr("INTERVAL 2 MINUTES")
    assert e.get(b"a") == b"1" and e.get(b"a", later) is None and e.get(b"b", later) == b"2"


def test_manifest(spark, tmp_path):
    m = Manifest()
    m.apply([{"op": "CREATE", "id": 1, "level": 0}, {"op": "CREATE", "id": 2, "level": 1}])
    for bad in ({"op": "CREATE", "id": 1, "level": 0}, {"op": "DELETE", "id": 9}, {"op": "?", "id": 5}):
        with pytest.raises(errors.ManifestError):
            m.apply([{"op": "DELETE", "id": 2}, bad])
    assert m.level(1) == [2] and m.next_id() == 3
    path = f"file://{tmp_path}/m"
    one, two = ManifestLog(spark, path, max_deletions=0), ManifestLog(spark, path)
    one.add([{"op": "CREATE", "id": 1, "level": 0}])
    with pytest.raises(errors.ManifestError):  # the number is taken
        two.add([{"op": "CREATE", "id": 7, "level": 0}])
    one.add([{"op": "DELETE", "id": 1}, {"op": "CREATE", "id": 2, "level": 3}])
    assert any(n.startswith("snapshot-") for n in __import__("os").listdir(tmp_path / "m"))
    one.add([{"op": "CREATE", "id": 3, "level": 3}])
    again = ManifestLog(spark, path)
    assert again.state.tables == {2: {"level": 3}, 3: {"level": 3}} and again.version == 3


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_wal(spark, tmp_path, fmt):
    w = Wal(spark, f"file://{tmp_path}/wal", fmt)
    assert (w.first_index, w.last_index) == (1, 0)
    data = {i: bytes([i, 0x80, 0xFF]) * i if i % 2 else f"text +{i}/é".encode() for i in range(1, 8)}
    w.write_batch([(i, data[i]) for i in range(1, 5)])
    w.write_batch([(i, data[i]) for i in range(5, 8)])
    with pytest.raises(errors.OutOfOrderError):
        w.write_batch([(9, b"")])
    assert w.read(7) == data[7] and w.read(2) == data[2]
    for i in (0, 8):
        with pytest.raises(errors.NotFoundError):
            w.read(i)
        with pytest.raises(errors.OutOfRangeError):
            w.truncate_front(i)
    w.truncate_front(3)
    w.truncate_back(6)
    again = Wal(spark, f"file://{tmp_path}/wal", fmt)
    assert {r["idx"]: bytes(r["data"]) for r in again.records().collect()} == {i: data[i] for i in range(3, 7)}
    again.write_batch([(7, b"next")])
    assert again.read(7) == b"next"
    again.close()
    with pytest.raises(errors.ClosedError):
        again.close()


def test_cuckoo():
    f, rng = membership.ScalableCuckooFilter(64), random.Random(1)
    keys = [str(rng.random()).encode() for _ in range(3000)]
    assert all(f.insert(k) for k in keys) and all(f.lookup(k) for k in keys) and f.count == 3000
    assert sum(f.lookup(b"no" + k) for k in keys) < 300
    back = membership.ScalableCuckooFilter.decode(f.encode())
    assert all(back.lookup(k) for k in keys) and back.count == 3000
    assert all(f.delete(k) for k in keys) and f.count == 0 and not f.lookup(keys[0])
    assert f.insert_unique(b"x") and not f.insert_unique(b"x")
    for raw in (b"", b"abc", b"x" * 12):
        with pytest.raises(ValueError):
            membership.CuckooFilter.decode(raw)
    full = membership.CuckooFilter(8)
    held = [k for k in keys if full.insert(k)]
    assert len(held) <= 8 and all(full.lookup(k) for k in held)
    assert membership.xxh64(b"") == 0xEF46DB3751D8E999


def test_reads_against_a_dict(spark):
    rng, rows, expected = random.Random(3), [], {}
    for seq in range(400):
        op = rng.choice([0, 1, 2, 3])
        rows.append((f"k{rng.randrange(30)}", str(seq), op, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq // 7), seq, None))
    for k, v, op, *_ in rows:
        if op == 2:
            expected.pop(k, None)
        elif op != 3:
            expected[k] = v
    df = spark.createDataFrame(rows, "key string, value string, op int, commit_ts timestamp, seq long, expires_at timestamp")
    assert {r["key"]: r["value"] for r in log.live(df).collect()} == expected
    assert log.live(df.limit(0)).count() == 0


def test_scans(spark):
    keys = ["", "a", "aa", "ab", "b", "ba", "é", "z"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: (r["prev_key"], r["next_key"]) for r in scan.neighbours(df, prefix_chars=1).collect()}
    order = sorted(keys, key=str.encode)
    assert got == {k: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, k in enumerate(order)}
    assert scan.seek_before(df, "").count() == 0
    n = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    sums = {r["id"]: r["s"] for r in scan.running_sum(n, "id", "v", "s", 64).collect()}
    assert all(sums[i] == sum(x % 7 for x in range(i)) for i in range(0, 1000, 37))


def test_level_targets():
    got = tables.level_targets({}, 4, 100, 10, 10, 2, 5)
    assert got["targets"] == [0, 100, 100, 100] and got["base"] == 3
    got = tables.level_targets({3: 5000}, 4, 100, 10, 10, 2, 5)
    assert got["targets"] == [0, 100, 500, 5000] and got["base"] == 2 and got["file_sizes"] == [5, 10, 20, 40]


def test_debounce_edges(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=9)), ("a", t + dt.timedelta(seconds=19)), ("b", t)], "k string, ts timestamp")
    got = sorted((r["k"], r["triggers"], r["fires_at"]) for r in ttl.debounced(df, "k", "ts", 10).collect())
    assert got == [("a", 1, t + dt.timedelta(seconds=29)), ("a", 2, t + dt.timedelta(seconds=19)), ("b", 1, t + dt.timedelta(seconds=10))]


def test_stream_ingest(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id")
    for k in range(2):
        source.filter(F.col("event_id") % 2 == k).repartition(1).write.parquet(f"file://{tmp_path}/in/{k}")
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    shaped = rows.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.lit(C.INSERT).alias("op"), F.col("event_id").alias("pos"), F.lit(None).cast("timestamp").alias("expires_at"))
    e = Engine(spark, f"file://{tmp_path}/db")
    for _ in range(2):  # the second run finds nothing new
        q = ingest(shaped, e, f"file://{tmp_path}/cp")
        q.awaitTermination(120)
        assert q.exception() is None
    assert e.log().count() == source.count() and e.live().count() == source.select("user_id").distinct().count()


def test_stream_expirations(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[("a", 0), ("b", 0)], [("a", 5), ("b", 30)], [("z", 4000)], [("z", 4001)]]):
        spark.createDataFrame([(k, t + dt.timedelta(seconds=s)) for k, s in rows], "k string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    src = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = expirations(src, "k", "ts", 10, late="1 second").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], (r["fired_at"] - t).total_seconds()) for r in spark.sql("SELECT * FROM fired").collect()}
    assert got == {("a", 15.0), ("b", 10.0), ("b", 40.0)}
