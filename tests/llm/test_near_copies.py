"""The pipeline's near-duplicate stage against all pairs by exact Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline

from siltstone.llm import simhash


def grams(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set())


def least_of_groups(texts):
    sets, root = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return sorted(set(root.values()))


def test_near_copies_stage(spark):
    rng = random.Random(3)
    texts = {}
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(120 + 10 * group)]
        for k in range(8):
            texts[100 * group + k] = " ".join(words)
            # chains: each is an edit of the one before, or of the first
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    texts |= {5000: "one two three", 5001: "one two four", 5002: "One two  three", 5003: "", 5004: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = least_of_groups(texts)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == expected
    # three bits of the three-word fingerprint leave near copies in
    assert len(simhash.keep_one(docs).collect()) > len(expected)


def test_similarity_bound(spark):
    """16 of 20 shingles is similar enough, 15 of 20 is not."""
    words = [f"w{i}" for i in range(24)]
    texts = {1: " ".join(words[:22]), 2: " ".join(words[2:]), 3: " ".join(f"v{w}" for w in words[:22]), 4: " ".join([f"v{w}" for w in words[3:24]] + ["vz"])}
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect())
    assert len(grams(texts[1]) & grams(texts[2])) * 5 == 4 * len(grams(texts[1]) | grams(texts[2]))
    assert len(grams(texts[3]) & grams(texts[4])) * 5 < 4 * len(grams(texts[3]) | grams(texts[4]))
    assert got == least_of_groups(texts) == [1, 3, 4]
