"""Fingerprints have the 64 samples that their standard error needs."""

import math

from siltstone.llm import fingerprints, queries


def test_64_samples(spark, sf):
    assert math.sqrt(0.25 / fingerprints.SAMPLES) <= 0.0625
    assert {len(r["fingerprint"]) for r in queries.QUERIES["op2_fingerprints"](spark, sf).select("fingerprint").collect()} == {64 * fingerprints.SAMPLE_BITS // 4}
