"""A large batch is several tables, of which no task writes more than about a memtable's bytes."""

from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.sources.store import Engine, Options
from siltstone.streaming.ingest import ingest

OPTIONS = Options(memtable_size=20_000, table_size=20_000, base_level_size=50_000)


def _expected(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["event_id"]):
        out.pop(r["key"], None) if r["op"] == C.DELETE else out.__setitem__(r["key"], str(r["event_id"])) if r["op"] != C.READ else None
    return out


def test_stream_batch_of_several_tables(spark, tmp_path):
    # a third of the rows are versions of one key
    made = spark.range(6000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "common").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.when(F.col("id") % 11 == 0, C.DELETE).when(F.col("id") % 7 == 0, C.READ).otherwise(C.UPDATE).alias("op"))
    made.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"file://{tmp_path}/in")
    rows = stream.select(F.col("key").cast("binary").alias("key"), F.col("event_id").cast("string").cast("binary").alias("value"), "op", F.col("event_id").alias("pos"), F.lit(None).cast("timestamp").alias("expires_at"))
    e, at = Engine(spark, f"file://{tmp_path}/db", OPTIONS), f"file://{tmp_path}/cp"
    for _ in range(2):  # the second run finds nothing new
        ingest(rows, e, at).awaitTermination()
    tables = list(e.manifest.state.tables.values())
    size = sum(t["bytes"] for t in tables)
    assert len(tables) >= size // OPTIONS.memtable_size > 1 and max(t["bytes"] for t in tables) < 2 * OPTIONS.memtable_size
    assert {t["batch"] for t in tables} == {1} and e.streamed(at) == 0
    assert sum(t["rows"] for t in tables) == e.log().count() == made.filter(F.col("op") != C.READ).count()
    expected = _expected(made.collect())
    view = lambda: {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in e.live().collect()}
    assert view() == expected and e.get(b"common") == expected["common"].encode()
    for t in tables:  # each file is in order
        keys = [(bytes(r["key"]), r["seq"]) for r in spark.read.parquet(f"{e.root}/{t['path']}").select("key", "seq").collect()]
        assert keys == sorted(keys)
    for _ in range(8):
        if not e.compact():
            break
    assert view() == expected == {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in Engine(spark, e.root).live().collect()}
    for level in range(1, OPTIONS.max_levels):
        spans = sorted((t["lo"], t["hi"]) for t in e.manifest.state.tables.values() if t["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
