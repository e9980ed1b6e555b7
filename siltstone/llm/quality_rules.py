"""Quality rules: each rule is evaluated once into a ledger of measurements and failure bits; policies are masks over the bits.

All of it is DataFrame expressions: a ledger is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, table, unused, words

#: Fixed values of the symbol rule.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A test that is true where a document fails; its bit in the ledger never changes once published."""

    bit: int
    name: str
    fails: str


#: Expressions over the measurements. A new rule gets the next bit; a changed one gets a new bit too.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "dup_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
    Rule(6, "exclamations", "5 * n_exclamations > n_words"),
    Rule(7, "repeat_some", "100 * n_repeat_words > 30 * n_words"),
)
#: What the base verdict rests on.
BASE_BITS = 0b11
#: Versioned policies: which bits reject.
POLICIES = {"base-1": 0b11, "strict-1": 0b11111111, "standard-1": 0b01111111}
POLICY = "standard-1"


def mask_of(*names: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


def _repeat_words(ws: Column, bits: Column) -> Column:
    """How many words lie in a 3-word window whose words occur in a further window of the text.

    A window is one long: as much of its hash as leaves room for its position, above that position. Sorted longs bring equal
    windows together, in order of position; a window is repeated if a neighbour has its hash. Then each repeated window adds
    the words that the one before it did not cover: n log n, however often a window occurs, and eight bytes a window in the
    sort. Of n windows two unequal ones look equal with a probability below n ** 3 / 2 ** 64. bits: those that a position takes.
    """
    n = F.size(ws)
    long = lambda c: F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")
    up, down = (lambda x: F.call_function("shiftleft", x, bits)), (lambda x: F.call_function("shiftrightunsigned", x, bits))
    packed = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: up(F.xxhash64(ws[i], ws[i + 1], ws[i + 2])).bitwiseOR(long(i)))
    )

    def repeated(s: Column) -> Column:
        m = F.size(s)
        again = F.filter(s, lambda x, i: ((i > 0) & (down(F.get(s, i - 1)) == down(x))) | ((i + 1 < m) & (down(F.get(s, i + 1)) == down(x))))
        mask = up(long(1)) - long(1)
        return F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        fresh = F.transform(p, lambda x, i: F.when(i == 0, long(3)).otherwise(F.least(long(3), x - F.get(p, i - 1))))
        return F.aggregate(fresh, long(0), lambda total, x: total + x)

    # let-bindings by one-element arrays: each array is made once, not once for each reference
    positions = F.transform(F.array(F.sort_array(packed)), repeated)
    return F.transform(positions, covered)[0]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements as columns. Null texts measure as empty ones; other columns stay as they are.

    n_lines counts the lines (split at newlines) that have a word; n_dup_lines those equal to an earlier one.
    Columns of docs that have a measurement's name are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    ws, lines, bits = (unused(docs, x) for x in ("_words", "_lines", "_bits"))
    length = lambda c: F.char_length(c).cast("long")
    kept_of = lambda chars: length(t) - length(F.translate(t, chars, ""))
    # in projections of their own, so that the lines are gone when the words are split
    counted = docs.withColumn(lines, full).withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "word_chars": length(F.translate(t, SPACE_CHARS, "")),
        "n_symbols": kept_of(SYMBOLS),
        "n_upper": length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "n_exclamations": kept_of("!"),
    }).drop(lines)
    split = counted.withColumn(ws, words(F.col(text))).withColumn(bits, F.length(F.bin(F.size(ws).cast("long"))))
    return split.withColumns({"n_words": F.size(ws).cast("long"), "n_repeat_words": _repeat_words(F.col(ws), F.col(bits))}).drop(ws, bits)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure() plus fail_bits: bit i is set where the rule of bit i fails. An empty text fails few_words only."""
    measured = measure(docs, text)
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledgered: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds base_failed, policy and kept; no text is read again for another policy."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return ledgered.withColumns({"base_failed": failed(BASE_BITS), "policy": F.lit(policy), "kept": ~failed(POLICIES[policy] | BASE_BITS)})


def ablations(ledgered: DataFrame, policy: str = POLICY) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that only it rejects, and kept without it."""
    mask = POLICIES[policy]
    rules = [r for r in RULES if mask >> r.bit & 1]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    by_bits = ledgered.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most two to the number of rules
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for r in rules for c in (F.col("bits").bitwiseAND(1 << r.bit) != 0, F.col("bits") == 1 << r.bit, F.col("bits").bitwiseAND(mask & ~(1 << r.bit)) == 0)]
    wide = by_bits.agg(F.array(*sums).alias("a"))
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("a")[3 * i].alias("failed"), F.col("a")[3 * i + 1].alias("only"), F.col("a")[3 * i + 2].alias("kept_without")) for i, r in enumerate(rules)])
    return wide.select(F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements, bits and verdict of every document under POLICY. Null doc_ids and repeated rows stay as they are."""
    judged = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")
