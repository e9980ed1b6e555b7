"""Probes of sharded filters: a filter is sent to a task, not with each row."""

import datetime as dt

from pyspark.sql import functions as F

from siltstone.operators import membership


def _sent(df):
    """Rows of df, and the bytes that its last stage sent to Python workers."""
    rows = df.collect()

    def below(node):
        if node.nodeName() == "ResultQueryStage":
            return below(node.plan())
        metric = node.metrics().get("pythonDataSent")
        kids = node.children()
        return (metric.get().value() if metric.isDefined() else 0) + sum(below(kids.apply(i)) for i in range(kids.size()))

    return rows, below(df._jdf.queryExecution().executedPlan().executedPlan())


def test_filters_do_not_travel_with_rows(spark):
    n = 4000
    keys = spark.range(n).select(F.col("id").cast("string").alias("key"))
    filters = membership.build_filters(keys, 2).localCheckpoint()
    size = sum(len(x) for r in filters.collect() for x in r["filters"])
    probe = spark.range(2 * n).select(F.col("id").cast("string").alias("key"), "id")
    rows, sent = _sent(membership.probe_filters(probe, filters, 2))
    assert sorted(r["id"] for r in rows) == list(range(2 * n)) and all(r["maybe"] for r in rows if r["id"] < n)
    assert sum(r["maybe"] for r in rows) < 1.1 * n
    assert 0 < sent < 20 * size + 200 * 2 * n  # not a filter for each row


def test_probe_columns_and_absent_filters(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "shard long, key string, ts timestamp, more struct<a: array<int>>, m map<string, int>"
    rows = [(i, str(i % 50) if i else None, t, ([i],), {"x": i}) for i in range(100)]
    probe = spark.createDataFrame(rows, schema)
    filters = membership.build_filters(spark.createDataFrame([(str(i),) for i in range(50)], "key string"), 4).localCheckpoint()
    got = membership.probe_filters(probe, filters, 4)
    assert got.columns == [*probe.columns, "maybe"] and got.dtypes[:-1] == probe.dtypes
    assert sorted(tuple(r)[:4] + (r["m"]["x"],) for r in got.collect()) == sorted(r[:4] + (r[4]["x"],) for r in [(i, k, ts, a, m) for i, k, ts, a, m in rows]) and all(r["maybe"] == (r["key"] is not None) for r in got.collect())
    some = {r["key"] for r in membership.probe_filters(probe, filters.filter("shard = 1"), 4).collect() if r["maybe"]}
    assert 0 < len(some) < 50
    assert not any(r["maybe"] for r in membership.probe_filters(probe, filters.limit(0), 4).collect())
