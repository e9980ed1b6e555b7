"""SimHash near-duplicates: fingerprints of word shingles, pairs by multi-index hashing, components by star contraction.

Equal fingerprints are one class before any pair is made, so copies cost one row each. Classes are paired by two
32-bit segments: if two fingerprints differ in at most 3 bits, one segment differs in at most 1, so each class probes
the 33 values within one bit of each of its segments and pairs are verified on all 64 bits inside the join. A class
has at most 43,744 others within 3 bits whatever the size of the corpus, and links are stored and joined, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, unused

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_SEGMENTS, _SEGMENT_BITS = 2, 32
#: The 256 bytes' bits.
_UNPACKED = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text: bit i is 1 where over half of the shingles' XXH64 have it. 0 without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both concern ASCII only
    if not found:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) < shingle_words:
        hashes = [hashed(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends.tolist()
        hashes = [hashed(joined[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :])]
    counts = np.zeros(64, np.int64)
    of_bytes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts[8 * k : 8 * k + 8] = np.bincount(of_bytes[:, k], minlength=256) @ _UNPACKED
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def links(classes: DataFrame) -> DataFrame:
    """a < b for each pair of the distinct longs in column fp that differ in at most MAX_BITS bits, each pair once."""
    low = F.lit((1 << _SEGMENT_BITS) - 1).cast("long")
    segment = [F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", _SEGMENT_BITS)]
    entries = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), s.alias("value")) for i, s in enumerate(segment)])).alias("x")).select("x.segment", "x.value", F.col("fp").alias("b"))
    ball = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << i).cast("long") for i in range(_SEGMENT_BITS)])
    probes = (
        classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), s.alias("value")) for i, s in enumerate(segment)])).alias("x"))
        .select("fp", "x.segment", "x.value", F.explode(ball).alias("mask"))
        .select("segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col("fp").alias("a"))
    )
    differ = F.col("a").bitwiseXOR(F.col("b"))
    e, p = entries.alias("e"), probes.alias("p")
    meet = (F.col("p.segment") == F.col("e.segment")) & (F.col("p.value") == F.col("e.value"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= MAX_BITS)
    # a pair that meets in both segments is taken from the first only
    once = (F.col("p.segment") == 0) | (F.bit_count(differ.bitwiseAND(low)) > 1)
    # the planner does not see that probes are many rows a class, and would broadcast them where classes are small
    return p.join(e.hint("merge"), meet & near & once).select("a", "b")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the least node that each node of edges (a, b) reaches. Stars are contracted in rounds, each written out.

    A round lets each node's larger neighbours, then its smaller ones, point at the least of its neighbours. Rounds grow
    with the logarithm of the longest chain; joins, not gathered lists, carry them, so a hub may have any degree.
    """
    spark = edges.sparkSession
    now, state = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    for _ in range(max_rounds):
        before, state = state, _state(now)
        if state == before or state[0] == 0:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(cut(least, "least"), "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = cut(large, "large")
        # large has a < b: each b points at its smaller neighbours a; all of them and b point at the least
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        now = cut(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k, fp, root, component_id for each row of docs: k is a hash of the text, root the least fingerprint it reaches,
    component_id the least doc_id (null where the whole component has none). Null and empty texts have fingerprint 0."""
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), _fingerprints(F.col(text)).alias("fp")), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    stars = components(links(classes.select("fp")))
    rooted = classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = cut(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = cut(rooted.join(named, "root").select("fp", "root", "component_id"), "members")
    return prints.join(member, "fp").select("doc_id", "k", "fp", "root", "component_id")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of found (doc_id, k: hash of the text, root): the one of least doc_id (null last),
    then of least k. Rows that agree in both have one text; of them one stays, by a hash of all columns."""
    cols, k = docs.columns, unused(docs, "_k")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k")).alias("x"))
    # (doc_id, k) decides the root, so no two components keep the same one
    kept = cut(first.select(F.col("x.doc_id").alias("_id"), F.col("x.k").alias("_text")), "kept")
    stay = docs.withColumn(k, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(k) == F.col("_text")), "left_semi")
    return stay.groupBy("doc_id", k).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("_row")).select("_row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component of fingerprints."""
    return keep_least(docs, near_duplicates(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; repeated rows stay, and a null doc_id is never a component's name unless
    the component has no other."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
