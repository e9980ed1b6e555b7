"""Mixing sources to target weights by entropy balancing.

Document rates stay as near to one as the token constraints allow: of all rates r with sum(size * r) = target in each source,
those of least relative entropy to one, in tokens, are r = exp(lambda of the source). The convex dual, the sum of
size * exp(lambda) - lambda * target, is solved by Newton iterations on per-source sums; the constraints share no document,
so its Hessian is diagonal and every source steps on its own row of a distributed table: nothing goes to the driver.

Rates become whole copies by the ranks of documents in order of size: document k of a source gets
floor(k r + u) - floor((k - 1) r + u) copies. As neighbours have about the same size, the words taken differ from the target
by at most about the source's largest document, whatever the number of documents; of several starts u the best is taken, and one
document's copies are changed by one where that brings the words nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3.0
NEWTON_STEPS = 40
_SALTS = 256
#: Roundings that are tried for each source.
_STARTS = 48


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """source, source_size, n_docs, target from one row a source with source_size.

    A source has its share by weight of all sizes, up to max_rate times its size; the excess is shared again by weight. In
    ascending order of size over weight the sources that stop are a prefix, so that running sums give the level at which
    the others share.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("ratio", F.col("source_size") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    below, through = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = weighted.withColumns({
        "rest": F.sum("source_size").over(everything) - max_rate * F.coalesce(F.sum("source_size").over(below), F.lit(0)),
        "rest_weight": F.sum("weight").over(through),
    }).withColumn("level", F.col("rest") / F.col("rest_weight"))
    stops = F.col("level") > max_rate * F.col("ratio")
    # the level of the first source that does not stop holds for all after it
    final = levelled.withColumn("share", F.min(F.when(~stops, F.struct("ratio", "level"))).over(everything)["level"])
    return final.select("source", "source_size", "n_docs", F.when(stops, max_rate * F.col("source_size")).otherwise(F.coalesce("share", "level") * F.col("weight")).cast("double").alias("target"))


def dual(balanced: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds lambda, where the dual's derivative source_size * exp(lambda) - target is 0, and rate = exp(lambda).

    Newton's step is (target - source_size * exp(lambda)) / (source_size * exp(lambda)), held within 1 so that a start far
    below does not overshoot. Sources of no words or no target have rate 0 and lambda null.
    """
    def step(now: Column, _: Column) -> Column:
        mass = F.col("source_size") * F.exp(now)
        return now + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("target") - mass) / mass))

    solved = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))
    return balanced.withColumn("lambda", solved).withColumn("rate", F.coalesce(F.exp("lambda"), F.lit(0.0)))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, row_hash (of the text), source, size, source_size, target, rate, copies for each row of docs.

    Null texts are empty. Texts without words have size 0, rank first and get copies like others; a null source is a source.
    Equal rows are documents of their own. Documents of one source and size are told apart by hash; ranks come from counts by (source, size), then by salt, then within a
    salt, so no task holds all documents of a source.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_hash"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    sized = cut(sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(_SALTS)).cast("int")), "sizes")
    # counts by salt are at most _SALTS rows for each source and size; all else is made from them
    salted = cut(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "salted")
    by_size = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    solved = cut(dual(targets(by_source, weights, max_rate)), "rates")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size_at = by_size.withColumn("size_before", before(Window.partitionBy("source").orderBy("size"))).drop("n")
    salt_at = salted.withColumn("salt_before", before(Window.partitionBy("source", "size").orderBy("salt"))).drop("n")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    placed = salt_at.join(size_at, same(salt_at, size_at, "source", "size")).select(salt_at["source"], salt_at["size"], "salt", (F.col("size_before") + F.col("salt_before")).alias("before"))
    placed = cut(placed.join(solved, same(placed, solved, "source")).select(placed["source"], "size", "salt", "before", "source_size", "target", "rate"), "placed")
    ranked = sized.join(placed, same(sized, placed, "source", "size", "salt")).select("doc_id", "row_hash", sized["source"], sized["size"], sized["salt"], "before", "source_size", "target", "rate")
    within = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", "row_hash", F.lit(1)), "doc_id", "row_hash")
    ranked = cut(ranked.withColumn("k", F.col("before") + F.row_number().over(within)).drop("salt", "before"), "ranked")

    def copies(u: Column) -> Column:
        k = F.col("k").cast("double")
        return F.least((F.floor(k * F.col("rate") + u) - F.floor((k - 1) * F.col("rate") + u)).cast("long"), F.lit(int(max_rate)).cast("long"))

    # each start u in the first unit is as good a rounding; the one whose words come nearest to the target is taken
    tried = [(i + 0.5) / _STARTS for i in range(_STARTS)]
    sums = ranked.groupBy("source").agg(F.first("target").alias("goal"), *[F.sum(F.col("size") * copies(F.lit(u))).alias(f"_u{i}") for i, u in enumerate(tried)])
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_u{i}") - F.col("goal")).alias("off"), F.lit(u).alias("u"), (F.col("goal") - F.col(f"_u{i}")).alias("short")) for i, u in enumerate(tried)]))
    best = cut(sums.select("source", off["u"].alias("u"), off["short"].alias("short")), "starts")
    joined = ranked.join(best, same(ranked, best, "source")).select("doc_id", "row_hash", ranked["source"], "size", "source_size", "target", "rate", "k", "short", copies(F.col("u")).alias("copies"))
    # then one copy more or less of the document whose size is nearest to what is still missing or too much
    may = F.when(F.col("short") > 0, F.col("copies") + 1 <= max_rate).otherwise(F.col("copies") > 0) & (F.abs(F.col("size") - F.abs("short")) < F.abs("short"))
    last = cut(joined.filter(may).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("short")).alias("d"), "k"))["k"].alias("last_k")), "last")
    fixed = joined.join(last, same(joined, last, "source"), "left")
    change = F.when(F.col("k") == F.col("last_k"), F.signum("short").cast("long")).otherwise(F.lit(0).cast("long"))
    return fixed.select("doc_id", "row_hash", joined["source"], "size", "source_size", "target", "rate", (F.col("copies") + change).alias("copies"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows of equal doc_id, text and source each get the rounded mean of
    their copies, once at least if any is taken."""
    mixed = mix(docs, **options)
    taken = mixed.groupBy("doc_id", "row_hash", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    t = taken.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), F.col("source").alias("_source"), "copies", "n")
    keyed = docs.withColumn("_row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(t, keyed["doc_id"].eqNullSafe(t["_id"]) & (keyed["_row_hash"] == t["_hash"]) & keyed["source"].cast("string").eqNullSafe(t["_source"]))
    return joined.select(*[keyed[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.col("copies") / F.col("n"))).cast("int"))).alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "rate")
