"""Ids of more than six digits keep their rows and their digits."""

from siltstone.plans import registry


def test_long_ids(spark, tmp_path):
    spark.createDataFrame([(7,), (999_999,), (1_000_000,), (123_456_789,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: (r["name"], r["parsed"]) for r in registry.QUERIES["table_names"](spark, str(tmp_path)).collect()}
    assert got == {7: ("000007.sst", 7), 999_999: ("999999.sst", 999_999), 1_000_000: ("1000000.sst", 1_000_000), 123_456_789: ("123456789.sst", 123_456_789)}
