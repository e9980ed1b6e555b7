"""Named queries over the test tables, one or more an operator, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.operators import log, membership, scan, tables, ttl, txn
from siltstone.plans import inputs as I  # noqa: E741
from siltstone.sources import manifest, scratch, wal
from siltstone.sources.store import Engine, Options
from siltstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOG = f"""log AS (SELECT CAST(user_id AS VARCHAR) AS key, props AS value, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 1 END AS op,
    ts AS commit_ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL {I.TTL_DAYS} DAY END AS expires_at FROM events)"""
_LATEST = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, seq DESC) AS rn FROM log WHERE op <> 3) WHERE rn = 1)"
_STORED = f"""stored AS (SELECT o_orderkey AS key, CAST(strlen(o_orderpriority) + 16 AS BIGINT) AS size, o_orderkey // {I.TABLE_KEYS} AS table_id,
    CASE (o_orderkey // {I.TABLE_KEYS}) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM orders)"""
_STATS = "stats AS (SELECT table_id, level, min(key) AS smallest, max(key) AS biggest, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes FROM stored GROUP BY ALL)"
_WAL = "wal AS (SELECT event_id + 1 AS idx, props AS data, CAST(strlen(props) + 8 AS BIGINT) AS size FROM events)"
_CHANGES = """changes AS (SELECT event_id // 10 AS change_set, CAST(event_id % 10 AS INTEGER) AS pos, user_id AS id, CASE event_type WHEN 'signup' THEN 'CREATE' ELSE 'DELETE' END AS op,
    CAST(user_id % 3 AS INTEGER) AS level FROM events WHERE event_type IN ('signup', 'error'))"""
_WIDTH = 4096
_MID, _KEYS = "2024-01-10 00:00:00", ("7", "11", "42", "99", "no such key")


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


# the change log


@query(f"WITH {_LOG}, {_LATEST} SELECT key, value, op, seq FROM latest")
def latest_per_key(spark, sf):
    return log.latest(log.writes(I.change_log(spark, sf))).select("key", "value", "op", "seq")


@query(f"WITH {_LOG}, {_LATEST} SELECT key, value, seq FROM latest WHERE op <> 2")
def live_view(spark, sf):
    return log.live(I.change_log(spark, sf)).select("key", "value", "seq")


@query(f"WITH {_LOG.replace('FROM events', f"FROM events WHERE ts <= TIMESTAMP '{_MID}'")}, {_LATEST} SELECT key, value, seq FROM latest WHERE op <> 2")
def snapshot_asof(spark, sf):
    return log.as_of(I.change_log(spark, sf), _ntz(_MID)).select("key", "value", "seq")


@query(f"WITH {_LOG} SELECT key, seq, op, commit_ts, lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts, seq) AS valid_to FROM log WHERE op <> 3")
def version_history(spark, sf):
    return log.history(I.change_log(spark, sf)).select("key", "seq", "op", "commit_ts", "valid_to")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def lww_composite(spark, sf):
    version = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return log.latest(I.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *version), ["l_orderkey", "l_linenumber"], version)


@query(f"WITH {_LOG}, {_LATEST} SELECT key, value, seq FROM latest WHERE op <> 2 AND key IN {_KEYS}")
def point_get(spark, sf):
    return log.get(I.change_log(spark, sf), *_KEYS).select("key", "value", "seq")


@query(f"WITH {_LOG}, {_LATEST} SELECT key, value, seq FROM latest WHERE op <> 2 AND key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 5)")
def multi_get(spark, sf):
    wanted = I.read(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("key"))
    return log.multi_get(I.change_log(spark, sf), wanted).select("key", "value", "seq")


@query(f"WITH {_LOG}, {_LATEST} SELECT key, value, seq FROM latest WHERE op <> 2")
def merge_tables(spark, sf):
    """Three overlapping runs, merged by version and not by position."""
    whole = log.writes(I.change_log(spark, sf))
    return log.merge(*[whole.filter(F.col("seq") % 3 == k) for k in (2, 0, 1)]).filter(F.col("op") != C.DELETE).select("key", "value", "seq")


# ordered access


def _orders(spark, sf):
    return I.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))


_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders"


@query(f"SELECT * FROM ({_TEXT}) WHERE key >= '1500' AND key < '17'")
def range_scan(spark, sf):
    return scan.range_scan(_orders(spark, sf), "1500", "17")


@query(f"SELECT * FROM ({_TEXT}) WHERE key LIKE '77%'")
def prefix_scan(spark, sf):
    return scan.prefix_scan(_orders(spark, sf), "77")


@query(f"SELECT key, row_number() OVER (ORDER BY key) AS position FROM ({_TEXT})")
def ordered_keys(spark, sf):
    return scan.positions(_orders(spark, sf))


@query(f"SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM ({_TEXT})")
def prev_next(spark, sf):
    return scan.neighbours(_orders(spark, sf))


@query(f"SELECT max(key) AS key FROM ({_TEXT}) WHERE key < '42'")
def seek_before(spark, sf):
    return scan.seek_before(_orders(spark, sf), "42")


@query(f"SELECT min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM ({_TEXT})")
def first_last_key(spark, sf):
    return _orders(spark, sf).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


@query(f"WITH {_WAL} SELECT idx, size FROM wal ORDER BY idx DESC LIMIT 64")
def fifo_retention(spark, sf):
    """A ring of 64 slots holds the last 64 records."""
    return scan.newest(I.wal(spark, sf).select("idx", "size"), 64, "idx")


@query(f"WITH {_WAL} SELECT (idx - 1) % 64 AS slot, max(idx) AS idx FROM wal GROUP BY 1")
def ring_slots(spark, sf):
    """What each slot of a ring of 64 holds: the last record that went there."""
    return I.wal(spark, sf).groupBy(((F.col("idx") - 1) % 64).alias("slot")).agg(F.max("idx").alias("idx"))


# transactions and requests


_BATCH = "SELECT o_custkey AS batch, count(*) AS entries, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderpriority) + 8) AS BIGINT) AS bytes FROM orders GROUP BY 1"


def _batches(spark, sf):
    rows = I.read(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    return txn.batch_sizes(rows, "batch")


@query(_BATCH)
def txn_batch_size(spark, sf):
    return _batches(spark, sf)


@query(f"SELECT *, bytes >= 400 AS too_big FROM ({_BATCH})")
def too_big(spark, sf):
    return txn.too_big(_batches(spark, sf), 400)


@query("""SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN props END AS value
    FROM events WHERE event_type <> 'view'""")
def txn_operations(spark, sf):
    """Operations by name: reads are dropped, deletes lose their value."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "insert", "click", "update", "purchase", "update", "error", "delete", "view", "read")])
    e = I.read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), C.op_code(names[F.col("event_type")]).alias("op"), "props")
    return e.filter(F.col("op") != C.READ).select("seq", "key", "op", F.when(F.col("op") != C.DELETE, F.col("props")).alias("value"))


@query(f"WITH {_WAL} SELECT (idx - 1) // 100 AS batch, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM wal GROUP BY 1")
def group_commit(spark, sf):
    """Requests coalesced a hundred at a time."""
    return I.wal(spark, sf).groupBy(F.floor((F.col("idx") - 1) / 100).alias("batch")).agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))


# time to live


@query(f"WITH {_LOG}, {_LATEST} SELECT key, seq, expires_at FROM latest WHERE op <> 2 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{I.NOW}')")
def ttl_live(spark, sf):
    return log.live(I.change_log(spark, sf), _ntz(I.NOW)).select("key", "seq", "expires_at")


@query(f"WITH {_LOG} SELECT seq, date_diff('microsecond', TIMESTAMP '{I.NOW}', expires_at) AS remaining FROM log WHERE op <> 3 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{I.NOW}')")
def ttl_remaining(spark, sf):
    live = ttl.expire(log.writes(I.change_log(spark, sf)), _ntz(I.NOW))
    return live.select("seq", ttl.remaining_micros(F.col("expires_at"), _ntz(I.NOW)).alias("remaining"))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS triggers, max(ts) + INTERVAL 86400 SECOND AS fires_at FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run
    FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 86400 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def ttl_debounce(spark, sf):
    return ttl.debounced(I.read(spark, sf, "events"), "user_id", "ts", 86_400)


# the write-ahead log


@query(f"""WITH {_WAL} SELECT segment, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes
    FROM (SELECT *, CAST((sum(size) OVER (ORDER BY idx) - size) // {I.SEGMENT_BYTES} AS BIGINT) AS segment FROM wal) GROUP BY segment""")
def wal_segments(spark, sf):
    placed = wal.segments(I.wal(spark, sf), "idx", "size", I.SEGMENT_BYTES, _WIDTH)
    return placed.groupBy("segment").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query(f"WITH {_WAL} SELECT * FROM wal WHERE idx >= 500")
def wal_truncate_front(spark, sf):
    return wal.truncate_front(I.wal(spark, sf), 500)


@query(f"WITH {_WAL} SELECT * FROM wal WHERE idx <= 500")
def wal_truncate_back(spark, sf):
    return wal.truncate_back(I.wal(spark, sf), 500)


@query(f"WITH {_WAL} SELECT idx, prev_idx FROM (SELECT idx, lag(idx) OVER (ORDER BY idx) AS prev_idx FROM wal WHERE idx % 97 <> 5 AND idx % 89 <> 6) WHERE idx <> prev_idx + 1")
def wal_gaps(spark, sf):
    return wal.gaps(I.wal(spark, sf).filter("idx % 97 <> 5 AND idx % 89 <> 6"), _WIDTH)


@query(f"WITH {_WAL} SELECT min(idx) AS first_idx, max(idx) AS last_idx FROM wal UNION ALL SELECT 1, 0")
def wal_bounds(spark, sf):
    return wal.bounds(I.wal(spark, sf)).unionAll(wal.bounds(I.wal(spark, sf).filter("idx < 0")))


@query(f"WITH {_WAL} SELECT idx, data FROM wal WHERE idx = 77")
def wal_read(spark, sf):
    return I.wal(spark, sf).filter(F.col("idx") == 77).select("idx", "data")


@query(f"WITH {_WAL} SELECT idx, data FROM wal")
def wal_json(spark, sf):
    """Records through their JSON lines and back."""
    lines = I.wal(spark, sf).select(wal.encode_json(F.col("idx"), F.col("data").cast("binary")).alias("line"))
    return lines.select(wal.decode_json(F.col("line")).alias("r")).select("r.idx", F.col("r.data").cast("string").alias("data"))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, max(event_id + 1) AS idx, arg_max(props, event_id) AS value FROM events GROUP BY 1""")
def wal_replay(spark, sf):
    """The memtable that a log rebuilds: the last record of each key, that of the last index included."""
    e = I.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") + 1).alias("idx"), F.col("props").alias("value"))
    return log.latest(e, ["key"], ["idx"])


# tables, levels and compaction


def _stats(spark, sf):
    return tables.table_stats(I.stored(spark, sf)).withColumn("level", F.when(F.col("table_id") % 5 == 0, 0).when(F.col("table_id") % 5 == 1, 1).otherwise(2))


@query(f"WITH {_STORED}, {_STATS} SELECT * FROM stats")
def table_stats(spark, sf):
    return _stats(spark, sf)


@query(f"""WITH {_STORED}, {_STATS}, wide AS (SELECT table_id, level, smallest, biggest + 700 AS biggest FROM stats) SELECT a.table_id AS left_id, b.table_id AS right_id FROM wide a JOIN wide b
    ON a.level = 0 AND b.level = 1 AND a.smallest <= b.biggest AND b.smallest <= a.biggest""")
def overlap_tables(spark, sf):
    wide = tables.with_slices(_stats(spark, sf).withColumn("biggest", F.col("biggest") + 700), 1000)
    return tables.overlapping(wide.filter("level = 0"), wide.filter("level = 1"))


@query(f"""WITH {_STORED} SELECT block, min(key) AS first_key, max(key) AS last_key, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(b) AS BIGINT) AS "offset"
    FROM (SELECT *, CAST(b // {I.BLOCK_BYTES} AS BIGINT) AS block FROM (SELECT *, sum(size) OVER (ORDER BY key) - size AS b FROM stored)) GROUP BY block""")
def block_index(spark, sf):
    return tables.block_index(I.stored(spark, sf), "key", "key", "size", I.BLOCK_BYTES, _WIDTH)


@query("SELECT id, repeat('0', greatest(0, 6 - length(digits))) || digits || '.sst' AS name, id AS parsed, CAST(NULL AS BIGINT) AS parsed_other FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS digits FROM orders)")
def table_names(spark, sf):
    named = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.table_name(F.col("o_orderkey")).alias("name"))
    return named.select("id", "name", C.parse_table_id(F.concat(F.lit("a/"), "name")).alias("parsed"), C.parse_table_id(F.concat(F.col("name"), F.lit("x"))).alias("parsed_other"))


@query("SELECT event_id, lower(hex(encode(props))) || printf('%016x', epoch_us(ts)) AS key_hex, epoch_us(ts) AS micros, CAST(0 AS BIGINT) AS micros_short FROM events")
def key_with_ts(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = I.read(spark, sf, "events").select("event_id", C.key_with_ts(F.col("props"), micros).alias("k"))
    return e.select("event_id", F.lower(F.hex("k")).alias("key_hex"), C.parse_ts(F.col("k")).alias("micros"), C.parse_ts(F.lit("12345678")).alias("micros_short"))


@query(f"""WITH {_STORED}, {_STATS}, s AS (SELECT level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes, CASE level WHEN 0 THEN count(*) / 4.0::DOUBLE ELSE sum(bytes)::DOUBLE / 20000 END AS score FROM stats GROUP BY level)
    SELECT *, CASE WHEN score >= 1 THEN score / greatest(coalesce(lead(score) OVER (ORDER BY level), 0), 0.01) ELSE score END AS adjusted FROM s""")
def level_scores(spark, sf):
    return tables.compaction_priority(tables.level_scores(_stats(spark, sf).withColumn("target", F.lit(20_000)), 4))


@query(f"""WITH {_STORED}, sizes AS (SELECT CAST(sum(size) AS BIGINT) AS last FROM stored) SELECT level, CASE level WHEN 0 THEN 0 WHEN 1 THEN greatest(last // 100, 5000) WHEN 2 THEN greatest(last // 10, 5000)
    ELSE greatest(last, 5000) END AS target FROM sizes, range(4) r(level)""")
def level_targets(spark, sf):
    last = I.stored(spark, sf).agg(F.sum("size").alias("s")).first()["s"]
    got = tables.level_targets({3: last}, 4, 5000, 10, 1000, 2, 1000)
    return spark.createDataFrame(list(enumerate(got["targets"])), "level long, target long")


@query(f"WITH {_STORED}, {_STATS} SELECT level, count(*) AS tables, max(table_id) AS last_id FROM stats GROUP BY level")
def level_tables(spark, sf):
    return _stats(spark, sf).groupBy("level").agg(F.count("*").alias("tables"), F.max("table_id").alias("last_id"))


@query(f"""WITH {_STORED}, {_STATS} SELECT level, table_id, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN table_id ELSE smallest END) AS position FROM stats""")
def level_order(spark, sf):
    """The first level's tables in order of id, those of the others in order of smallest key."""
    order = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, F.col("table_id")).otherwise(F.col("smallest")))
    return _stats(spark, sf).select("level", "table_id", F.row_number().over(order).cast("long").alias("position"))


@query(f"WITH {_STORED}, {_STATS} SELECT level, min(smallest) AS lo, max(biggest) AS hi, CAST(sum(CASE WHEN smallest <= 5000 AND biggest >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS met FROM stats GROUP BY level")
def level_ranges(spark, sf):
    """The key range that a level's tables span, and how many of them a range meets."""
    meets = C.overlaps(F.col("smallest"), F.col("biggest"), F.lit(1000), F.lit(5000))
    return _stats(spark, sf).groupBy("level").agg(F.min("smallest").alias("lo"), F.max("biggest").alias("hi"), F.count_if(meets).alias("met"))


@query(f"WITH {_STORED}, {_STATS}, t AS (SELECT *, row_number() OVER (ORDER BY table_id) AS nth FROM stats WHERE level = 0 AND bytes < 1000000) SELECT table_id, smallest, biggest FROM t WHERE nth <= 8 AND (SELECT count(*) FROM t) >= 4")
def level_zero_pick(spark, sf):
    """The oldest eight small tables of the first level, if there are four: the inputs of a compaction within it."""
    small = _stats(spark, sf).filter("level = 0 AND bytes < 1000000").orderBy("table_id").limit(8).select("table_id", "smallest", "biggest")
    return small.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).filter("_n >= 4").drop("_n")


@query(f"WITH {_LOG}, {_LATEST} SELECT key, op, seq FROM latest")
def compaction_output(spark, sf):
    """Compaction of some tables keeps the newest version of each key, deletes included, while deeper tables may hold the key."""
    return log.latest(log.writes(I.change_log(spark, sf))).select("key", "op", "seq")


@query(f"WITH {_LOG}, {_LATEST} SELECT key, op, seq FROM latest WHERE op <> 2 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{I.NOW}')")
def tombstone_gc(spark, sf):
    """Compaction into the last level drops deletes and what has expired."""
    return log.live(I.change_log(spark, sf), _ntz(I.NOW)).select("key", "op", "seq")


@query("SELECT CAST(0 AS BIGINT) AS differences")
def compaction_invariance(spark, sf):
    """The live view of a log whose older half is compacted is that of the log."""
    whole = I.change_log(spark, sf)
    old, new = whole.filter(F.col("commit_ts") <= _ntz(_MID)), whole.filter(F.col("commit_ts") > _ntz(_MID))
    after, before = (log.live(x).select("key", "value", "seq") for x in (log.merge(log.writes(old)).unionByName(new), whole))
    return after.exceptAll(before).unionAll(before.exceptAll(after)).agg(F.count("*").alias("differences"))


# the engine and its stream


_ENGINE = """SELECT key, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, props AS value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'view')
    WHERE rn = 1 AND event_type <> 'error'"""


def _entries(df):
    """events as an engine's rows: event_id orders the writes of a batch."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", C.INSERT).when(kind == "error", C.DELETE).when(kind == "view", C.READ).otherwise(C.UPDATE)
    return df.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), op.alias("op"), F.col("event_id").alias("pos"), F.lit(None).cast("timestamp").alias("expires_at"))


def _shown(db):
    return db.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(_ENGINE)
def engine_view(spark, sf):
    """Three batches written to an engine, compacted level by level, opened again and read."""
    events, root = I.read(spark, sf, "events"), scratch.folder(spark, "engine")
    db = Engine(spark, root, Options(level_zero_tables=2, base_level_size=1 << 14, table_size=1 << 14, max_levels=4))
    edges = events.agg(F.percentile_approx("event_id", [0.33, 0.66]).alias("q")).first()["q"] or [0, 0]
    for part in (F.col("event_id") <= edges[0], F.col("event_id").between(edges[0] + 1, edges[1]), F.col("event_id") > edges[1]):
        db.append(_entries(events.filter(part)))
    while db.compact():
        pass
    db.close()
    return _shown(Engine(spark, root))


@query(_ENGINE)
def stream_ingest(spark, sf):
    """events as a stream into an engine, a micro-batch a batch."""
    root = scratch.folder(spark, "stream")
    db = Engine(spark, f"{root}/db")
    source = f"{sf}/events.parque[t]"  # a pattern: a stream takes no single file by its name
    stream = spark.readStream.schema(I.read(spark, sf, "events").schema).parquet(source)
    ingest.ingest(_entries(stream), db, f"{root}/checkpoint").awaitTermination()
    return _shown(db)


# the manifest


@query(f"WITH {_CHANGES} SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_set DESC, pos DESC) AS rn FROM changes) WHERE rn = 1 AND op = 'CREATE'")
def manifest_replay(spark, sf):
    return manifest.replay(I.manifest_changes(spark, sf))


@query(f"""WITH {_CHANGES} SELECT change_set, pos, id, op, level FROM (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY change_set, pos) AS was FROM changes)
    WHERE (op = 'CREATE' AND was = 'CREATE') OR (op = 'DELETE' AND was IS DISTINCT FROM 'CREATE')""")
def manifest_violations(spark, sf):
    return manifest.violations(I.manifest_changes(spark, sf))


@query(f"""WITH {_CHANGES}, last AS (SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_set DESC, pos DESC) AS rn FROM changes) WHERE rn = 1 AND op = 'CREATE')
    SELECT level, count(*) AS tables, max(id) + 1 AS next_id FROM last GROUP BY level""")
def manifest_levels(spark, sf):
    return manifest.replay(I.manifest_changes(spark, sf)).groupBy("level").agg(F.count("*").alias("tables"), (F.max("id") + 1).alias("next_id"))


# membership


def _customers(spark, sf):
    return I.read(spark, sf, "customer").select(F.col("c_custkey").alias("key"))


def _ordering(spark, sf):
    return I.read(spark, sf, "orders").select(F.col("o_custkey").alias("key"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def membership_semi(spark, sf):
    return membership.contained(_customers(spark, sf), _ordering(spark, sf))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def membership_anti(spark, sf):
    return membership.missing(_customers(spark, sf), _ordering(spark, sf))


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem")
def dedup_insert_unique(spark, sf):
    return I.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()


@query("SELECT count(DISTINCT o_custkey) AS present, count(DISTINCT o_custkey) AS found, true AS few_false FROM orders")
def cuckoo_probe(spark, sf):
    """Every key of the filters is found; of keys that are not there, few are."""
    keys = _ordering(spark, sf).distinct()
    shards = 8
    filters = membership.build_filters(keys.select(F.col("key").cast("string").alias("key")), shards)
    probe = keys.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("real")).unionByName(keys.select(F.concat(F.lit("x"), F.col("key").cast("string")).alias("key"), F.lit(False).alias("real")))
    got = membership.probe_filters(probe, filters, shards)
    return got.agg(F.count_if("real").alias("present"), F.count_if(F.col("real") & F.col("maybe")).alias("found"), (F.count_if(~F.col("real") & F.col("maybe")) <= 0.1 * F.count_if(~F.col("real")) + 5).alias("few_false"))
