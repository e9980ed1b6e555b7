"""Document fingerprints by consistent weighted sampling (ICWS) of weighted words.

For a word of weight w (its count) sample k draws r, c from Gamma(2, 1) and b from U(0, 1), all from a hash of
(word, k); t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The word of least a, with its t, is sample k:
two texts agree on a sample with probability sum(min) / sum(max) of their weights, the generalised Jaccard
similarity. Draws depend on the word and k only, so texts are never compared and nothing is shared.

DataFrame functions only. A sample is kept as one long: the order-preserving bits of ln a above 16 bits that
identify (word, t), so that the least is a plain min() on longs, which hash aggregation does in place.

The least a of a text of n words is exponential with mean 1 / n, so few words come near it. A word whose a, by a bound
below it that takes no logarithm, is over NEAR / n is left out of that sample. A sample whose least a is found below
NEAR / n is thereby exact; settled() makes the others, about one row in 2e8, again from all words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, range_bounds, range_bucket, shuffle_partitions, table, words

#: Samples of a fingerprint. The likeness of two has a standard error of sqrt(J (1 - J) / SAMPLES).
SAMPLES = 64
#: Bits of a sample that are kept: unequal samples look equal once in 65,536.
SAMPLE_BITS = 16
_HEX = SAMPLE_BITS // 4
#: Samples that one row of the aggregation keeps; few enough for the compiled loop to stay small.
_BLOCK = 4
#: How many times the mean of a text's least a a word's a may be. A sample's least is above that with probability exp(-NEAR).
NEAR = 24.0
#: ln a is kept in steps of 1 / _STEPS; for these draws it is between -1000 and 4.
_STEPS = 2.0**36


def _terms(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str]) -> DataFrame:
    """keys, _n, _h, _c, _w0, _w1 ...: the words of a row's shortest text, hash of each distinct word of its texts and its
    count in each, null where it is not there.

    A text without words has one term of its own, hash 0 and count 1. One more row of each row has _c, the columns carried;
    _c is null beside words, so that what is long is not copied for each.
    """
    c = F.struct(*carried, F.lit(True).alias("_own"))
    none = F.lit(None).cast("array<string>")
    split = rows.select(*keys, c.alias("_own"), *[words(F.col(t)).alias(f"_ws{i}") for i, t in enumerate(texts)])
    sides = [F.struct(F.lit(i).alias("side"), F.col(f"_ws{i}").alias("ws"), F.when(F.lit(False), F.col("_own")).alias("c")) for i in range(len(texts))] + [F.struct(F.lit(-1).alias("side"), none.alias("ws"), F.col("_own").alias("c"))]
    n = F.array_min(F.array(*[F.greatest(F.size(f"_ws{i}"), F.lit(1)) for i in range(len(texts))]))
    each = split.select(*keys, n.alias("_n"), F.explode(F.array(*sides)).alias("_x")).select(*keys, "_n", "_x.side", "_x.c", "_x.ws")
    # the array is a column of its own here, so that the rows of its words don't carry it
    each = each.select(*keys, "_n", F.col("side").alias("_side"), F.col("c").alias("_c"), F.explode_outer("ws").alias("_word"))
    h = F.when(F.col("_word").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("_word"))
    return each.select(*keys, "_n", "_c", "_side", h.alias("_h")).groupBy(*keys, "_n", "_h", "_c").agg(*[F.sum(F.when(F.col("_side") == i, 1)).alias(f"_w{i}") for i in range(len(texts))])


def _uniforms(h: Column, k: Column) -> list[Column]:
    """exp(-r), b and exp(-c) of a word, by its hash, in sample k."""
    one = F.xxhash64(h.bitwiseXOR(k.cast("long")))
    two = F.xxhash64(one)
    # uniform numbers from 20, 20 and 24 bits of one hash and 32 and 32 bits of the other
    unit = lambda x, shift, mask, scale: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask).cast("long")).cast("double") * F.lit(scale) + F.lit(scale / 2)
    exp_r = unit(one, 0, 0xFFFFF, 2.0**-20) * unit(one, 20, 0xFFFFF, 2.0**-20)
    b = unit(one, 40, 0xFFFFFF, 2.0**-24)
    return [exp_r, b, unit(two, 0, 0xFFFFFFFF, 2.0**-32) * unit(two, 32, 0xFFFFFFFF, 2.0**-32)]


def _draws(h: Column, k: Column) -> list[Column]:
    """r, b and ln c of a word, by its hash, in sample k."""
    exp_r, b, exp_c = _uniforms(h, k)
    return [-F.ln(exp_r), b, F.ln(-F.ln(exp_c))]


def _can_be_near(h: Column, k: Column, most: Column, once: Column) -> Column:
    """False only where a is over the limit for every text of the row; most: the limit times the word's greatest count.

    With count w, a is at least c exp(-r) / w, and with count 1 it is c exp(-r (1 - b)), which is at least
    c exp(-r) / (1 - b (1 - exp(-r))); c = -ln p is at least 2 (1 - p) / (1 + p). once is 1 where no count is above 1, else 0.
    """
    exp_r, b, exp_c = _uniforms(h, k)
    one = F.lit(1.0)
    return F.lit(2.0) * (one - exp_c) * exp_r <= most * (one + exp_c) * (one - once * b * (one - exp_r))


def _sample(h: Column, ln_w: Column, r: Column, b: Column, ln_c: Column) -> Column:
    """A term's sample as a long that is the less, the less its a is; null for a word that a text does not have."""
    # a word that occurs once has ln w = 0, so t = 0
    t = F.when(ln_w == 0, F.lit(0.0)).otherwise(F.rint(ln_w / r + b - F.lit(0.5)))
    ln_a = ln_c - r * (t - b + F.lit(1.0))
    fixed = (ln_a * F.lit(_STEPS)).cast("long")
    which = h.bitwiseXOR(t.cast("long")).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1).cast("long"))
    return F.shiftleft(fixed, SAMPLE_BITS).bitwiseOR(which)


def _signed(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str], samples: int, near: float | None) -> DataFrame:
    """As signatures(), but a fingerprint is null where near leaves a sample open; nothing is left open where it is None.

    Where rows is already dealt out by some of keys, this adds no exchange.
    """
    sides, block = range(len(texts)), math.gcd(samples, _BLOCK)
    own, k = F.col("_c").isNotNull(), F.col("_k")
    terms = _terms(rows, keys, texts, carried).withColumn("_m", F.array_max(F.array(*[f"_w{i}" for i in sides])).cast("double"))
    # texts of few words have all their samples made
    limit = F.when(F.col("_n") > F.lit(2 * near), F.lit(near) / F.col("_n")) if near else F.lit(None).cast("double")
    ks = F.when(own, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, range(samples))))
    # the bound is tried a little above the limit, so that rounding leaves out nothing that is below it
    most, once = F.coalesce(limit * F.col("_m") * F.lit(1.0 + 1e-9), F.lit(1e300)), F.when(F.col("_m") == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    last = F.coalesce(F.shiftleft((F.ln(limit) * F.lit(_STEPS)).cast("long") + F.lit(1), SAMPLE_BITS), F.lit(2**63 - 1).cast("long"))
    drawn = terms.select(*keys, "_c", "_h", *[F.ln(F.col(f"_w{i}").cast("double")).alias(f"_l{i}") for i in sides], most.alias("_most"), once.alias("_once"), last.alias("_last"), F.explode(ks).alias("_k"))
    if near:
        drawn = drawn.filter((k < 0) | _can_be_near(F.col("_h"), k, F.col("_most"), F.col("_once")))
    drawn = drawn.select("*", *[x.alias(f"_d{n}") for n, x in zip("rbc", _draws(F.col("_h"), k))])
    for i in sides:
        made = _sample(F.col("_h"), F.col(f"_l{i}"), *[F.col(f"_d{n}") for n in "rbc"])
        # a projection for each text: what it reads of the one before is made once
        drawn = drawn.select("*", (F.when(F.col(f"_l{i}") == F.col(f"_l{i - 1}"), F.col(f"_s{i - 1}")).otherwise(made) if i else made).alias(f"_s{i}"))
    kept = lambda i, j: F.when((F.col(f"_s{i}") <= F.col("_last")) & (F.pmod(k, F.lit(block)) == j), F.col(f"_s{i}"))
    least = drawn.groupBy(*keys, F.floor(k / block).cast("int").alias("_k"), "_c").agg(*[F.min(kept(i, j)).alias(f"_s{i}_{j}") for i in sides for j in range(block)])
    low = F.lit((1 << SAMPLE_BITS) - 1).cast("long")
    part = [F.concat(*[F.lower(F.lpad(F.hex(F.col(f"_s{i}_{j}").bitwiseAND(low)), _HEX, "0")) for j in range(block)]).alias(f"_p{i}") for i in sides]
    # the row of the columns carried has no samples, so its parts are null, which array_join passes over
    parts = least.select(*keys, "_k", "_c", *part).groupBy(*keys).agg(F.first("_c", ignorenulls=True).alias("_c"), F.sort_array(F.collect_list(F.struct("_k", *[f"_p{i}" for i in sides]))).alias("_parts"))
    joined = parts.select(*keys, *[F.col("_c")[x].alias(x) for x in carried], *[F.array_join(F.col(f"_parts._p{i}"), "").alias(f"fingerprint{i}") for i in sides])
    return joined.withColumns({f"fingerprint{i}": F.when(F.length(f"fingerprint{i}") == samples * _HEX, F.col(f"fingerprint{i}")) for i in sides})


def settled(make: Callable[[DataFrame, float | None], DataFrame], rows: DataFrame, unit: list[str], prints: list[str], near: float = NEAR) -> DataFrame:
    """make(rows, near), written to the shared folder; where it leaves one of the columns prints null, all rows of that
    unit, which both rows and result have as columns, are made again by make(rows, None), which leaves nothing open."""
    first = cut(make(rows, near), "fingerprints")
    is_open = F.lit(False)
    for p in prints:
        is_open = is_open | F.col(p).isNull()
    again = first.filter(is_open).select(*[F.col(u).alias(f"_open_{u}") for u in unit]).distinct()
    if again.isEmpty():
        return first
    same = F.lit(True)
    for u in unit:
        same = same & F.col(u).eqNullSafe(F.col(f"_open_{u}"))
    rest = cut(make(rows.join(again, same, "left_semi"), None), "fingerprints")
    return first.join(again, same, "left_anti").unionByName(rest)


def signatures(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str] | None = None, samples: int = SAMPLES, near: float = NEAR) -> DataFrame:
    """keys (which identify a row), the columns carried, and fingerprint0, fingerprint1 ... of the texts: strings of
    SAMPLE_BITS a sample in hexadecimal. The draws of a word are made once for all texts of its row, and a sample once for
    the texts in which its count is equal.

    Empty and null texts have a fingerprint of their own; equal texts have equal ones; a row of a null key keeps it. near
    changes the cost and no result.
    """
    return settled(lambda part, near: _signed(part, keys, texts, carried or [], samples, near), rows, keys, [f"fingerprint{i}" for i in range(len(texts))], near)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree, 0 to 1."""
    same = [F.when(F.substring(a, 1 + _HEX * k, _HEX) == F.substring(b, 1 + _HEX * k, _HEX), F.lit(1)).otherwise(F.lit(0)) for k in range(samples)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total.cast("double") / F.lit(float(samples))


def next_bucketed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs (doc_id, text) in buckets of consecutive doc_id, each with the first row of the bucket below at its end.

    Columns: bucket, key (doc_id; the least long for null), tie, sentinel, doc_id, text. In descending order of
    (key, tie) within a bucket each row's next row is the next document; after the last document comes the first.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), "tie": F.xxhash64("text")})
    bounds = range_bounds(keyed, "key", n_buckets)
    placed = keyed.withColumn("bucket", range_bucket(F.col("key"), bounds))
    # one row for each bucket: at most n_buckets
    tops = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    if not tops:
        return placed.withColumn("sentinel", F.lit(False)).select("bucket", "key", "tie", "sentinel", "doc_id", "text")
    order = sorted(tops)
    above = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    first = placed.filter(F.col("key").isin(list(above))).groupBy("key").agg(F.min_by(F.struct("tie", "doc_id", "text"), "tie").alias("x"))
    goes_to = F.element_at(F.create_map(*[F.lit(x) for pair in above.items() for x in pair]), F.col("key"))
    sentinels = first.select(goes_to.cast("int").alias("bucket"), "key", F.col("x.tie").alias("tie"), F.lit(True).alias("sentinel"), F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"))
    rows = placed.select("bucket", "key", "tie", F.lit(False).alias("sentinel"), "doc_id", "text")
    return rows.unionByName(sentinels)


def _pairs(placed: DataFrame, near: float | None) -> DataFrame:
    """bucket, doc_id, n_chars, edited_sha256 and the fingerprints of the text, the edited text and the next text."""
    down = Window.partitionBy("bucket").orderBy("sentinel", F.col("key").desc(), "tie")
    n_chars = F.char_length("text")
    cut_at = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut_at), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut_at))
    rows = placed.withColumns({"next_text": F.lead("text").over(down), "rn": F.row_number().over(down)}).select(
        "bucket", "rn", "doc_id", "sentinel", n_chars.cast("long").alias("n_chars"), "text",
        F.when(~F.col("sentinel"), edited).alias("edited"), F.when(~F.col("sentinel"), F.sha2(edited, 256)).alias("edited_sha256"),
    )
    signed = _signed(rows, ["bucket", "rn"], ["text", "edited"], ["doc_id", "sentinel", "n_chars", "edited_sha256"], SAMPLES, near)
    pairs = signed.withColumnsRenamed({"fingerprint0": "fingerprint", "fingerprint1": "edited_fingerprint"})
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn"))
    return pairs.withColumn("next_fingerprint", after).filter(~F.col("sentinel")).drop("rn", "sentinel")


def query(spark: SparkSession, sf_dir: str, near: float = NEAR) -> DataFrame:
    """Fingerprints of texts and edited texts.

    One exchange, of the texts by bucket: the next text, the words, the counts and the samples of a row are all made
    in its bucket. Documents of one doc_id follow each other by a hash of their text. Buckets with an open sample are made again.
    """
    placed = next_bucketed(table(spark, sf_dir, "documents"), min(2000, 4 * shuffle_partitions(spark)))
    pairs = settled(_pairs, placed, ["bucket"], ["fingerprint", "edited_fingerprint", "next_fingerprint"], near)
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
