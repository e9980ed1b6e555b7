"""The bound that leaves words out of samples saves most draws and changes no fingerprint."""

import math
import random

from pyspark.sql import functions as F

from siltstone.llm import fingerprints, queries


def test_bound_is_below_every_sample(spark):
    """No word with a sample under the limit is left out, whatever its counts; of 500 words less than a third get in."""
    limit = fingerprints.NEAR / 500
    counts = F.element_at(F.array(*map(F.lit, [1, 1, 1, 2, 3, 50])), (F.col("id") % 6 + 1).cast("int")).cast("double")
    terms = spark.range(3000).select(F.xxhash64("id").alias("h"), counts.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    draws = fingerprints._draws(F.col("h"), F.col("k"))
    last = int(math.log(limit) * fingerprints._STEPS) << fingerprints.SAMPLE_BITS
    # the text with the greatest count has it, the other has one
    near = [fingerprints._sample(F.col("h"), F.ln(w), *draws) <= last for w in (F.col("m"), F.lit(1.0))]
    can = fingerprints._can_be_near(F.col("h"), F.col("k"), F.lit(limit) * F.col("m"), F.when(F.col("m") == 1, 1.0).otherwise(0.0))
    got = terms.select("m", can.alias("can"), (near[0] | near[1]).alias("near")).groupBy("m").agg(
        F.sum(F.col("near").cast("int")).alias("near"), F.sum((F.col("near") & ~F.col("can")).cast("int")).alias("lost"), F.avg(F.col("can").cast("int")).alias("share")
    ).collect()
    assert len(got) == 4 and all(r["near"] > 0 and r["lost"] == 0 for r in got)
    assert all(r["share"] < 1 / 3 for r in got if r["m"] == 1)


def test_open_samples_are_made_again(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(n))
    rows = [(k, text(n), text(n)) for k, n in enumerate([0, 1, 30, 49, 100, 300, 1000, 3000])] + [(None, text(200), None), (20, text(200), "short"), (21, text(400), " ")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    prints = lambda d: {(r["k"], r["fingerprint0"], r["fingerprint1"]) for r in d.collect()}
    whole = prints(fingerprints._signed(df, ["k"], ["a", "b"], [], 64, None))
    assert len(whole) == len(rows) and all(len(p) == 64 * fingerprints.SAMPLE_BITS // 4 for r in whole for p in r[1:])
    some = prints(fingerprints._signed(df, ["k"], ["a", "b"], [], 64, 1.0))
    assert any(None in r[1:] for r in some) and all(p in (None, *q[1:]) for q in whole for r in some if r[0] == q[0] for p in r[1:])
    for near in (1.0, 4.0, fingerprints.NEAR):
        assert prints(fingerprints.signatures(df, ["k"], ["a", "b"], near=near)) == whole


def test_query_makes_open_buckets_again(spark, sf):
    assert sorted(fingerprints.query(spark, sf, near=3.0).collect()) == sorted(queries.QUERIES["op2_fingerprints"](spark, sf).collect())
