"""Near copies: candidates by SimHash and by bands of least hashes, an exact check of Jaccard similarity, components by star contraction.

SimHash pairs classes whose fingerprints of three-word shingles differ in at most three bits, by multi-index hashing as in simhash.py. At a
similarity of 0.8 fingerprints differ in about ten bits, which no segments reach, so bands of least hashes pair what SimHash leaves apart.

Texts of equal shingle sets are one class before any pair is made. A class has BANDS keys, each of ROWS least hashes; two classes
of similarity J share a key with probability 1 - (1 - J ** ROWS) ** BANDS, which at J = 0.8 falls short of 1 by 5 in a million.
Classes that share a key are candidates, and only pairs whose sets have the similarity are linked. Each class of a key first
meets one leader of the key, so that a large group of near copies costs a few pairs a class and not its square. Classes that
share a key and no link are dealt anew by sharper keys (SHARP_BANDS of SHARP_ROWS least hashes, as sure to join a pair at 0.8 and far
less likely to join one at 0.5). There pairs meet that no link has joined, whose sizes allow the similarity and whose
one-bit sketches do not differ by more than 5 standard deviations over what it lets expect. In all a pair at 0.8 is missed
about ten times in a million. Texts that are alike to just under the similarity still meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import components, fingerprint, keep_least, links

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 40, 6
SHARP_BANDS, SHARP_ROWS = 430, 16
#: Bits of a sketch, one of each of the first least hashes.
SKETCH_BITS = 1024
SEED = 42


def _odd(n: int, seed: int) -> np.ndarray:
    """Factors, each of which orders hashes anew."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = _odd(BANDS * ROWS, SEED)
_SHARP_FACTORS = _odd(SHARP_BANDS * SHARP_ROWS, SEED + 1)
#: Products made at once.
_PRODUCTS = 1 << 16


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, ascending; of all its words where they are fewer; none without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both concern ASCII only
    if not found:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    hashes = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :])] or [hashed(joined, SEED)]
    return np.unique(np.array(hashes, np.uint64))


def _least(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product of any of found with each factor."""
    least, step = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), max(1, _PRODUCTS // len(factors))
    for at in range(0, len(found), step):
        np.minimum(least, (found[at : at + step, None] * factors).min(axis=0), out=least)
    return least


def _keys(least: np.ndarray, rows: int) -> list[int]:
    import xxhash

    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(-1, rows))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def band_keys(found: np.ndarray) -> list[int]:
    """A signed long for each band; none for an empty set."""
    return _keys(_least(found, _FACTORS), ROWS) if len(found) else []


def sharp_keys(found: np.ndarray) -> tuple[list[int], list[int]]:
    """A signed long for each sharp band, and the sketch: a bit of each of the first least hashes, packed in longs."""
    least = _least(found, _SHARP_FACTORS)
    bits = ((least[:SKETCH_BITS] >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)
    return _keys(least, SHARP_ROWS), np.packbits(bits).view(np.int64).tolist()


def _class(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _agree(a: str, b: str, similarity: Fraction):
    """The sets' intersection is at least similarity of their union, in integers."""
    both, n, d = F.size(F.array_intersect(a, b)), similarity.numerator, similarity.denominator
    return both * F.lit(n + d) >= (F.size(a) + F.size(b)) * F.lit(n)


def _may_agree(x: str, y: str, similarity: Fraction):
    """The sizes allow the similarity, and so do the sketches, whose bits differ where least hashes do, every other time."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    p = float(1 - similarity) / 2
    most = int(SKETCH_BITS * p + 5 * (SKETCH_BITS * p * (1 - p)) ** 0.5)
    differ = [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH_BITS // 64)]
    return (small * F.lit(similarity.denominator) >= large * F.lit(similarity.numerator)) & (reduce(add, differ) <= most)


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def simhash_pairs(made: DataFrame) -> DataFrame:
    """a < b, classes that SimHash joins, of rows (cls, fp): the least class of a fingerprint stands for it, and meets the fingerprint's other
    classes and those that stand for the fingerprints within its bits. A class can have several fingerprints."""
    printed = cut(made.select("fp", "cls").distinct(), "printed")
    stands = cut(printed.groupBy("fp").agg(F.min("cls").alias("rep")), "stands")
    same = printed.join(stands.hint("merge"), "fp").select(*_pair("rep", "cls"))
    of_a, of_b = stands.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), stands.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b"))
    close = cut(links(stands.select("fp")), "close").join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b").select(*_pair("rep_a", "rep_b"))
    return same.union(close).filter("a <> b").distinct()


def near_copies(docs: DataFrame, similarity: Fraction = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, k, root, component_id for each row of docs: k is a hash of the text, root the least class it reaches, component_id the least doc_id there
    (null where the whole component has none). Null, empty and blank texts are one class."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, shingle_words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "k": b.column(1), "cls": pa.array([_class(x) for x in found], pa.int64()), "fp": pa.array([fingerprint(t) for t in b.column(2).to_pylist()], pa.int64()), "bands": pa.array([band_keys(x) for x in found], pa.list_(pa.int64()))})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, shingle_words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([_class(x) for x in found], pa.int64()), "found": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))})

    def sharper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [np.array(x, np.int64).view(np.uint64) for x in part.column(2).to_pylist()]
                keys = [sharp_keys(x) for x in found]
                columns = {"n": pa.array([len(x) for x in found], pa.int32()), "sketch": pa.array([x[1] for x in keys], pa.list_(pa.int64())), "bands": pa.array([x[0] for x in keys], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({"cls": part.column(0), "root": part.column(1)} | columns)

    texts = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    made = cut(texts.mapInArrow(prints, "doc_id long, k long, cls long, fp long, bands array<long>"), "prints")
    classes = cut(made.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("cls", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n"), F.min_by("cls", F.xxhash64("cls", "band")).alias("lead")).filter("n > 1").select("band", "lead")
    members = cut(entries.join(shared.hint("merge"), "band").select("band", "cls", "lead"), "members")
    by_simhash = cut(simhash_pairs(made), "by_simhash")
    # the sets of candidates only, each made again from one text of its class
    candidates = members.select("cls").union(by_simhash.select("a")).union(by_simhash.select("b")).distinct()
    wanted = classes.join(candidates, "cls", "left_semi").select("k")
    found = cut(texts.join(wanted.hint("merge"), "k", "left_semi").dropDuplicates(["k"]).select("text").mapInArrow(sets, "cls long, found array<long>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = found.select(F.col("cls").alias("a"), F.col("found").alias("of_a")), found.select(F.col("cls").alias("b"), F.col("found").alias("of_b"))
        return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").filter(_agree("of_a", "of_b", similarity)).select("a", "b")

    led = cut(linked(cut(by_simhash.union(members.filter("cls <> lead").select(*_pair("cls", "lead"))).distinct(), "pairs")), "led")
    stars = cut(components(led), "stars")
    now = members.join(stars.hint("merge"), members["cls"] == stars["node"], "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    now = cut(now, "now")
    apart = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    left = cut(now.join(apart.hint("merge"), "band", "left_semi").select("cls", "root").distinct(), "apart")
    sharp = cut(left.join(found.hint("merge"), "cls").select("cls", "root", "found").mapInArrow(sharper, "cls long, root long, n int, sketch array<long>, bands array<long>"), "sharp")
    entries = sharp.select("cls", "root", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    met = cut(entries.join(shared.hint("merge"), "band").join(sharp.select("cls", "n", "sketch").hint("merge"), "cls"), "met")
    one, two = met.alias("x"), met.alias("y")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & _may_agree("x", "y", similarity)
    rest = linked(cut(one.join(two.hint("merge"), meet).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "pairs"))
    stars = components(led.unionByName(rest))
    rooted = classes.join(stars.hint("merge"), classes["cls"] == stars["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    rooted = cut(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = cut(rooted.join(named, "root").select("cls", "root", "component_id"), "members")
    return made.join(member, "cls").select("doc_id", "k", "root", "component_id")


def keep_one(docs: DataFrame, similarity: Fraction = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs without all but one document of each component of near copies: the one of least doc_id."""
    return keep_least(docs, near_copies(docs, similarity, shingle_words))
