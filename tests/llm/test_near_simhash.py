"""The near-duplicate stage's SimHash step: pairs within three bits, which the exact check then judges."""

import random

import corpus_pipeline
from test_near_copies import least_of_groups

from siltstone.llm import near_copies, simhash


def test_simhash_pairs(spark):
    rng = random.Random(5)
    prints = {}
    for k in range(60):
        fp = rng.randrange(-(2**63), 2**63)
        for j in range(4):
            flipped = sum(1 << b for b in rng.sample(range(64), j + rng.randrange(2)))
            prints[10 * k + j] = (fp ^ flipped) if flipped < 2**63 else (fp ^ (flipped - 2**64))
    rows = [*prints.items(), (601, prints[0]), (602, prints[0]), (602, prints[10]), (0, prints[0])]
    reps = {}
    for c, fp in rows:
        reps[fp] = min(c, reps.get(fp, c))
    expected = {(reps[fp], c) for c, fp in rows if reps[fp] != c}
    expected |= {tuple(sorted((reps[x], reps[y]))) for x in reps for y in reps if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3 and reps[x] != reps[y]}
    got = near_copies.simhash_pairs(spark.createDataFrame(rows, "cls long, fp long")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(expected) and len(expected) > 60


def test_simhash_is_checked(spark):
    """A pair within three bits that is less alike than the stage's similarity stays apart, one that is as alike goes."""
    rng, texts = random.Random(5), {}
    while len(texts) < 2:
        words = [f"w{rng.randrange(5000)}" for _ in range(80)]
        other = list(words)
        for at in (10, 30, 50):
            other[at] = f"x{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        if ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (1 << 64) - 1).bit_count() <= 3:
            texts = {1: a, 2: b}
    texts |= {3: "v".join(a.split("w")), 4: "v".join(a.split("w")) + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == least_of_groups(texts) == [1, 2, 3]
