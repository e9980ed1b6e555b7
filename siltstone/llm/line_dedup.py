"""Line dedup by winnowing: lines that belong to a run of MIN_WORDS words or more that occurs earlier are deleted.

A window is a shortest run of consecutive lines with MIN_WORDS words: one from each line on, and one up to each line. The
least line hash of a window is its fingerprint. Any run of MIN_WORDS words holds a whole window, and a window's fingerprint
depends on its lines only, so a shared run always shares a fingerprint. Windows meet by fingerprint and are verified by the
hash of all their lines; each later one is a repeat, and the lines of the first one stay. Windows that grow to the right and to the left of a fingerprint overlap,
and their union is the whole repeated run: that is the extension both ways, without a comparison of pairs of documents, so a
passage in a third of all documents costs a row for each of its windows and no more.

DataFrame functions only. Order is that of doc_id (null last), then of the text's hash, then of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, table, word_count

#: Words that a repeated run has at least.
MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_key orders documents; _rk with it identifies a text. Rows that agree in both are one document."""
    return docs.withColumns({"_key": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "_rk": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, _rk, line, hash, words: the lines that have a word. Lines are equal if they are without outer white space."""
    each = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(F.btrim(x, F.lit(SPACE_CHARS))).alias("hash"), word_count(x).cast("int").alias("words")))
    found = F.filter(each, lambda x: x["words"] > 0)
    return _keyed(docs, doc_id, text).select("_key", "_rk", found.alias("_lines")).select("_key", "_rk", F.inline_outer("_lines")).filter("line IS NOT NULL")


def windows(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_key, _rk, first, last (lines), fingerprint, content of every window. Repeated rows of a document have the same ones."""
    doc = Window.partitionBy("_key", "_rk")
    once = found.groupBy("_key", "_rk", "line").agg(F.first("hash").alias("hash"), F.first("words").alias("words"))
    placed = once.withColumn("end", F.sum("words").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("words"))
    right = doc.orderBy("start").rangeBetween(0, min_words - 1)
    left = doc.orderBy("end").rangeBetween(1 - min_words, 0)
    grown = placed.select(
        "_key", "_rk", "line", "words",
        F.collect_list("hash").over(right).alias("rh"), F.max("line").over(right).alias("r_last"), F.sum("words").over(right).alias("rw"),
        F.collect_list("hash").over(left).alias("lh"), F.min("line").over(left).alias("l_first"), F.sum("words").over(left).alias("lw"),
    )

    def window(first: Column, last: Column, hashes: Column, holds: Column) -> Column:
        return F.when(holds, F.struct(first.alias("first"), last.alias("last"), F.array_min(hashes).alias("fingerprint"), F.xxhash64(hashes).alias("content")))

    # a window to the left that is also the one to the right from its first line is taken once
    both = F.array(window(F.col("line"), F.col("r_last"), F.col("rh"), F.col("rw") >= min_words), window(F.col("l_first"), F.col("line"), F.col("lh"), (F.col("lw") >= min_words) & (F.col("lw") - F.col("words") >= min_words)))
    return grown.select("_key", "_rk", both.alias("_both")).select("_key", "_rk", F.explode_outer("_both").alias("w")).filter("w IS NOT NULL").select("_key", "_rk", "w.first", "w.last", "w.fingerprint", "w.content")


def repeats(found: DataFrame) -> DataFrame:
    """The windows that occur more than once: _key, _rk, first, last, and again, which is false for the first occurrence."""
    at = F.struct("_key", "_rk", "first")
    seen = found.groupBy("fingerprint", "content").agg(F.min(at).alias("at"), F.count("*").alias("n")).filter("n > 1").select("fingerprint", "content", "at")
    # written, so that both sides of the join are plain exchanges and a passage that a third of all documents share is split
    seen = cut(seen, "seen")
    return found.join(seen, ["fingerprint", "content"]).select("_key", "_rk", "first", "last", (at > F.col("at")).alias("again"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated lines deleted from text, and n_deleted, the number of lines deleted. Every row stays, if only with
    an empty text; null texts stay null. Lines of a window's first occurrence stay, in whatever other window they are. Blank lines within a deleted run go with it. Columns named n_deleted are replaced."""
    found = cut(windows(lines(docs, doc_id, text), min_words), "windows")
    runs = repeats(found).groupBy("_key", "_rk").agg(*[F.collect_set(F.when(F.col("again") == x, F.struct("first", "last"))).alias(n) for x, n in ((True, "_again"), (False, "_source"))])
    spread = lambda c: F.flatten(F.transform(c, lambda r: F.sequence(r["first"], r["last"])))
    # a line of a first occurrence stays, so a run that overlaps its own repeats is not lost
    gone = runs.filter(F.size("_again") > 0).select("_key", "_rk", F.array_except(spread("_again"), spread("_source")).alias("_gone"))
    joined = _keyed(docs.drop("n_deleted"), doc_id, text).join(gone, ["_key", "_rk"], "left")
    parts = F.split(F.col(text), "\n")

    def without(x: Column) -> Column:
        # linear in the lines: the difference of the line numbers is taken by hashing
        stays = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
        return F.array_join(F.transform(stays, lambda i: x[i]), "\n")

    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.transform(F.array(parts), without)[0])
    return joined.withColumns({text: kept, "n_deleted": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}).withColumn("n_deleted", F.greatest("n_deleted", F.lit(0).cast("long"))).select(*docs.drop("n_deleted").columns, "n_deleted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
