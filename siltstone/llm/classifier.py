"""Quality classifier by co-training of a text view and a metadata view.

One logistic model sees what a text says (measures of its characters, words and lines, and hashed words), the other only what is
known about it: source, language, length, and of a page that carries it the host and the numbers of links, tags and character
references. Both start from the labelled sample. In each round each view scores every unlabelled document; those beyond its outermost
quantiles, whose evidence moves the odds far enough from the prior, get its label as training data of the other view. Then each view
is calibrated on labelled documents that no round trained on, and the views' log odds, less the prior that both contain, add up to
the score of every document. The same is done for each target; a document is kept if it is likely good and not likely toxic.

Texts are read once, into a table of features. Models are fitted on the driver from bounded samples, those of least hash: at most
LABELLED labelled rows, and MARKS rows of a class, view, target and round. Quantiles are taken over all unlabelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_bytes, cut, table, unused
from .url_filters import host_path

#: Bounds of the samples that are brought to the driver; a text brings its features only.
LABELLED, MARKS = 4000, 250
ROUNDS = 2
#: The share of unlabelled rows beyond a view's quantiles, both classes together, and how far from the prior the log odds of a mark are.
MARKED, EVIDENCE = 0.05, math.log(2)
#: Weight of a mark in a fit; a label has 1.
MARK_WEIGHT = 0.3
WORD_BUCKETS, META_BUCKETS = 1 << 18, 1 << 12
TARGETS, VIEWS = ("quality", "toxic"), ("text", "meta")
#: A bucket is a feature if so many training documents have it and its classes differ in it by so many standard errors.
LEAST_DOCS, LEAST_ERRORS = 5, 4.0
#: A document is kept if its probability of being good is at least KEEP and that of being toxic is below TOXIC.
KEEP, TOXIC = 0.5, 0.5
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
MEASURES = 10
STEMS = (5, 8)


def text_measures(text: str) -> list[float]:
    """MEASURES numbers of about unit size. An empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    if not n:
        return [0.0] * MEASURES
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    adjacent = sum(map(bytes.__eq__, found[1:], found[:-1]))
    return [
        math.log1p(n) / 8,
        min(n, 50) / 50,
        min(1.0, len(_SYMBOLS.findall(raw)) / n),
        min(1.0, raw.count(b"!") / n),
        upper / len(raw),
        adjacent / n,
        len(set(found)) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, len(raw) / n / 20),
        min(1.0, len(lines) / n),
    ]


def word_buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's words and of their beginnings of STEMS bytes, with letters A-Z in lower case and without
    punctuation at their ends. Beginnings tell forms of a word that the labelled sample has few of."""
    words = {w.strip(b".,;:!?()\"'|#*$%&") for w in text.encode("utf-8", "surrogatepass").lower().split()}
    stems = {w[:n] + b"-" for n in STEMS for w in words if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words | stems if w), np.int32))


_FAR = 65_535
#: Bounds of temporary arrays.
_ROWS_AT_ONCE, _VALUES_AT_ONCE = 200, 1 << 16


def packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets as unsigned 16-bit steps from one to the next, from -1 on; _FAR is a step that ends at no bucket."""
    steps = np.diff(buckets, prepend=-1)
    far = steps // _FAR
    out = np.full(int(far.sum()) + len(steps), _FAR, "<u2")
    out[np.cumsum(far + 1) - 1] = steps - far * _FAR
    return out.tobytes()


def unpacked(steps: np.ndarray, lengths: np.ndarray) -> Ragged:
    """The buckets of rows whose steps follow each other; lengths: steps of each row. Some rows at a time, for small temporary arrays."""
    flat, of_row, begin = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    for at in range(0, len(lengths), _ROWS_AT_ONCE):
        part = lengths[at : at + _ROWS_AT_ONCE]
        ends = np.cumsum(part, dtype=np.int64)
        own = steps[begin : begin + ends[-1]]
        begin += ends[-1]
        upto, stays = np.concatenate(([0], np.cumsum(own, dtype=np.int64))), own != _FAR
        n_stay = np.concatenate(([0], np.cumsum(stays)))
        values = upto[1:] - np.repeat(upto[ends - part], part) - 1
        flat.append(values[stays].astype(np.int32))
        of_row.append(n_stay[ends] - n_stay[ends - part])
    return Ragged(np.concatenate(flat), np.concatenate(of_row))


def page_facts(pages: DataFrame) -> DataFrame:
    """doc_id and what its pages say of it, one row a doc_id: the number after the path's first part is the document's."""
    host, path = host_path(F.col("url"))
    article = F.try_to_number(F.nullif(F.regexp_extract(path, r"^/[^/]+/(\d{1,18})(?!\d)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    page = F.coalesce("html", F.lit(""))
    n = lambda what: ((F.char_length(page) - F.char_length(F.replace(page, F.lit(what), F.lit("")))) / len(what)).cast("long")
    found = pages.select(article.alias("id"), host.alias("host"), n("<a ").alias("links"), n("<").alias("tags"), n("&").alias("references"), F.char_length(page).cast("long").alias("size"))
    return found.filter("id IS NOT NULL").groupBy("id").agg(F.min("host").alias("host"), *[F.max(c).alias(c) for c in ("links", "tags", "references", "size")])


def _meta() -> Column:
    """Buckets of what is known of a document: source, lang, n_chars, and the columns of page_facts."""
    log = lambda c: F.coalesce(F.least(F.lit(40), (2 * F.log2(1 + F.greatest(F.lit(0), c))).cast("int")), F.lit(-1)).cast("string")
    text = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    rate = lambda c: F.when(F.col("size") > 0, log(1000 * F.col(c) / F.col("size")))
    named = {"s": text("source"), "l": text("lang"), "n": log(F.col("n_chars")), "sl": F.concat(text("source"), F.lit("|"), text("lang"))}
    named |= {"h": F.col("host"), "a": log(F.col("links")), "t": rate("tags"), "r": rate("references"), "z": F.when(F.col("size") > 0, log(10 * F.col("n_chars") / F.col("size"))), "p": F.col("size").isNull().cast("string")}
    told = [F.pmod(F.crc32(F.encode(F.concat(F.lit(f"{k}="), v), "utf-8")), F.lit(META_BUCKETS)).cast("int") for k, v in named.items()]
    return F.array_compact(F.array(*told))


class Ragged:
    """Rows of different lengths: their values one after the other."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths, self.ends = flat.astype(np.int32, copy=False), lengths.astype(np.int64), np.cumsum(lengths, dtype=np.int64)

    def rows(self, which: np.ndarray) -> Ragged:
        lengths, ends = self.lengths[which], self.ends[which]
        return Ragged(np.concatenate([self.flat[:0], *(self.flat[b - n : b] for n, b in zip(lengths, ends))]), lengths)

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate((self.flat, other.flat)), np.concatenate((self.lengths, other.lengths)))


@dataclass
class Linear:
    """A logistic model over measures and buckets, and the line that calibrates its log odds."""

    dense: np.ndarray
    sparse: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, dense: np.ndarray, buckets: Ragged) -> np.ndarray:
        upto = np.concatenate(([0.0], np.cumsum(self.sparse[buckets.flat], dtype=np.float64)))
        return dense @ self.dense + upto[buckets.ends] - upto[buckets.ends - buckets.lengths] + self.bias

    def log_odds(self, dense: np.ndarray, buckets: Ragged) -> np.ndarray:
        return np.clip(self.slope * self.margin(dense, buckets) + self.shift, -12, 12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(dense: np.ndarray, buckets: Ragged, y: np.ndarray, width: int, weight: np.ndarray, l2: float = 1.0, steps: int = 250) -> Linear:
    """Logistic regression by Adam on all rows at once, over the measures and the buckets that tell the classes apart; deterministic."""
    n, d = len(y), dense.shape[1]
    flat, row = buckets.flat, np.repeat(np.arange(n, dtype=np.int32), buckets.lengths)
    docs_with, good_with, good_weight = np.zeros(width), np.zeros(width), weight * y
    for at in range(0, len(flat), _VALUES_AT_ONCE):
        part, of = flat[at : at + _VALUES_AT_ONCE], row[at : at + _VALUES_AT_ONCE]
        np.add.at(docs_with, part, weight[of])
        np.add.at(good_with, part, good_weight[of])
    good, total = good_weight.sum(), weight.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        p = docs_with / total
        errors = (good_with / good - (docs_with - good_with) / (total - good)) / np.sqrt(p * (1 - p) * (1 / good + 1 / (total - good)))
    chosen = np.flatnonzero((docs_with >= LEAST_DOCS) & (np.abs(np.nan_to_num(errors)) >= LEAST_ERRORS))
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    has = place[flat] >= 0
    flat, row = place[flat[has]].astype(np.int64), row[has].astype(np.int64)
    w = np.zeros(d + len(chosen) + 1)
    penalty = np.concatenate((np.full(d, 0.02 * l2), np.full(len(chosen), l2), [0.0])) / total
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = dense @ w[:d] + np.bincount(row, w[d + flat], minlength=n) + w[-1]
        e = (_sigmoid(z) - y) * weight / total
        g = np.concatenate((e @ dense, np.bincount(flat, e[row], minlength=len(chosen)), [e.sum()])) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    sparse = np.zeros(width, np.float32)
    sparse[chosen] = w[d:-1]
    return Linear(w[:d].copy(), sparse, float(w[-1]))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the log odds, by Newton's method with Platt's smoothed outcomes."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((pos + 1) / (neg + 1))
    x = np.stack((margin, np.ones_like(margin)), 1)
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (p - t) + np.array([1e-3 * a, 0]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return (float(a), float(b)) if a > 0 else (0.0, math.log((pos + 1) / (neg + 1)))


@dataclass
class Model:
    """The calibrated views of one target and its prior log odds."""

    text: Linear
    meta: Linear
    prior: float

    def log_odds(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        return self.text.log_odds(f.dense, f.words), self.meta.log_odds(np.zeros((len(f.dense), 0)), f.meta)

    def probability(self, f: Features) -> np.ndarray:
        text, meta = self.log_odds(f)
        return _sigmoid(text + meta - self.prior)


class Features:
    """The features of some rows, read from columns dense, words and meta of an Arrow batch or table."""

    def __init__(self, dense: np.ndarray, words: Ragged, meta: Ragged):
        self.dense, self.words, self.meta = dense, words, meta

    @classmethod
    def of(cls, b: pa.RecordBatch | pa.Table) -> Features:
        def ragged(name: str) -> Ragged:
            c = b.column(name)
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            return Ragged(c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()))

        words = b.column("words")
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].tobytes()
        dense = b.column("dense")
        dense = dense.combine_chunks() if isinstance(dense, pa.ChunkedArray) else dense
        return cls(dense.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, MEASURES), unpacked(np.frombuffer(data, "<u2"), np.diff(at) // 2), ragged("meta"))

    def rows(self, which: np.ndarray) -> Features:
        return Features(self.dense[which], self.words.rows(which), self.meta.rows(which))

    def view(self, name: str) -> tuple[np.ndarray, Ragged]:
        return (self.dense, self.words) if name == "text" else (np.zeros((len(self.dense), 0)), self.meta)

    def __add__(self, other: Features) -> Features:
        return Features(np.concatenate((self.dense, other.dense)), self.words + other.words, self.meta + other.meta)


def fit_views(sample: Features, y: np.ndarray, told: dict[str, tuple[Features, np.ndarray]]) -> Model:
    """The model of one target from labelled rows (y: 0, 1, or -1 for no label) and what each view has been told by the other.
    A quarter of the labelled rows is held out, for calibration."""
    labelled = np.flatnonzero(y >= 0)
    share = float((y[labelled] == 1).sum() + 1) / (len(labelled) + 2)
    prior = math.log(share / (1 - share))
    width = {"text": WORD_BUCKETS, "meta": META_BUCKETS}
    if len(labelled) < 8 or len(set(y[labelled])) < 2:  # nothing to tell apart
        flat = lambda v: Linear(np.zeros(sample.view(v)[0].shape[1]), np.zeros(width[v]), 0.0, 0.0, prior)
        return Model(flat("text"), flat("meta"), prior)
    held, train = labelled[::4], np.setdiff1d(labelled, labelled[::4])
    out = {}
    for v in VIEWS:
        rows, target, weight = sample.rows(train), y[train].astype(float), np.ones(len(train))
        if v in told:
            more, marks = told[v]
            rows, target, weight = rows + more, np.concatenate((target, marks)), np.concatenate((weight, np.full(len(marks), MARK_WEIGHT)))
        out[v] = fit(*rows.view(v), target, width[v], weight)
        out[v].slope, out[v].shift = calibrate(out[v].margin(*sample.rows(held).view(v)), y[held].astype(float))
    return Model(out["text"], out["meta"], prior)


def _inputs(docs: DataFrame) -> list[Column]:
    """text, source, lang, n_chars; what docs does not have is null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


def _row_hash(docs: DataFrame) -> Column:
    """With doc_id, tells rows of different input apart; rows of equal input have equal scores."""
    return F.xxhash64(*_inputs(docs))


def features(docs: DataFrame, labels: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, k, quality, toxic (null: no label), dense, words, meta of each row of docs, as a table of its own.

    labels: doc_id, quality, toxic; of several labels of a doc_id the least quality and the greatest toxic count. pages: url,
    html. Null texts are empty; a null doc_id has neither label nor page.
    """
    spark = docs.sparkSession
    schema = "doc_id long, k long, source string, lang string, n_chars long, dense array<float>, words binary"

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(2).to_pylist()]
                dense = pa.array([text_measures(t) for t in texts], pa.list_(pa.float32()))
                words = pa.array([packed(word_buckets(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *part.columns[3:], dense, words], names=["doc_id", "k", "source", "lang", "n_chars", "dense", "words"])

    with batch_bytes(spark):
        made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("k"), *_inputs(docs)).mapInArrow(featured, schema)
        no_page = "id long, host string, links long, tags long, references long, size long"
        facts = page_facts(pages) if pages is not None else spark.createDataFrame([], no_page)
        known = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")) if labels is not None else spark.createDataFrame([], "of long, quality int, toxic int")
        # rows without an id are dealt out by their hash, and meet nothing
        at = F.coalesce("doc_id", "k")
        named = F.col("doc_id").isNotNull()
        joined = made.join(facts, (at == F.col("id")) & named, "left").join(known, (at == F.col("of")) & named, "left")
        return cut(joined.select("doc_id", "k", "quality", "toxic", "dense", "words", _meta().alias("meta")), "features")


def _log_odds(rows: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """doc_id, k, and a column a target and view, such as quality_text."""
    told = rows.sparkSession.sparkContext.broadcast(models)
    names = [f"{t}_{v}" for t in TARGETS for v in VIEWS]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Features.of(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), *[pa.array(x) for m in told.value for x in m.log_odds(f)]], names=["doc_id", "k", *names])

    with batch_bytes(rows.sparkSession):
        return rows.select("doc_id", "k", "dense", "words", "meta").mapInArrow(scored, "doc_id long, k long, " + ", ".join(f"{n} double" for n in names))


def marks(odds: DataFrame, priors: dict[str, float], round_no: int, most: int = MARKS) -> DataFrame:
    """what (such as quality_text: the target, and the view that says so), y, k: the rows of odds (doc_id, k, log odds) that each
    view labels in a round: those beyond its quantile of a class whose log odds are EVIDENCE from the prior; of more than most rows
    of a view and class those of least hash. Rows of equal input share a k and are one mark."""
    share = {t: 1 / (1 + math.exp(-p)) for t, p in priors.items()}
    names = [f"{t}_{v}" for t in TARGETS for v in VIEWS]
    ends = {n: (MARKED * (1 - share[n.split("_")[0]]), 1 - MARKED * share[n.split("_")[0]]) for n in names}
    # one row: two numbers a view and target, over all rows
    at = odds.agg(*[F.percentile_approx(n, F.array(*map(F.lit, q)), F.lit(10_000)).alias(n) for n, q in ends.items()]).first()
    if at is None or at[names[0]] is None:
        return odds.sparkSession.createDataFrame([], "what string, y int, k long")
    said = []
    for n in names:
        prior, (low, high) = priors[n.split("_")[0]], at[n]
        for y, sure in ((1, (F.col(n) >= max(high, prior + EVIDENCE))), (0, F.col(n) <= min(low, prior - EVIDENCE))):
            said.append(F.when(sure, F.struct(F.lit(n).alias("what"), F.lit(y).alias("y"))))
    each = odds.select("k", F.explode(F.array_compact(F.array(*said))).alias("m")).select("m.what", "m.y", "k").distinct()
    order = Window.partitionBy("what", "y").orderBy(F.xxhash64("k", F.lit(round_no)), "k")
    return each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def marked(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """what, y, k, dense, words, meta of each mark: one row, however many rows of the pool have its k. Any of them will do, as a view
    is only told what the other says: copies have one text, and what the text says holds for the page of each."""
    of_k = pool.join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi").groupBy("k").agg(F.min(F.struct("doc_id", "dense", "words", "meta")).alias("row"))
    return of_k.join(F.broadcast(chosen), "k").select("what", "y", "k", "row.dense", "row.words", "row.meta").orderBy("what", "k", "y")


def _columns(rows: DataFrame, *names: str) -> pa.Table:
    return rows.select(*names).toArrow()


def co_train(rows: DataFrame, labelled: int = LABELLED, most: int = MARKS, rounds: int = ROUNDS) -> tuple[Model, Model]:
    """Models of quality and of toxicity from the table of features: labelled rows of least hash, one of each doc_id, and marks."""
    first = rows.filter("quality IS NOT NULL OR toxic IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "k").limit(labelled)
    sample = _columns(first, "doc_id", "quality", "toxic", "dense", "words", "meta")
    _, once = np.unique(sample.column("doc_id").to_numpy(), return_index=True)
    sample = sample.take(np.sort(once))
    known = Features.of(sample)
    ys = [np.nan_to_num(np.array(sample.column(t).to_pylist(), float), nan=-1).astype(int) for t in TARGETS]
    pool = rows.filter("quality IS NULL AND toxic IS NULL")
    told: dict[str, dict] = {t: {} for t in TARGETS}
    for r in range(rounds + 1):
        models = tuple(fit_views(known, y, told[t]) for t, y in zip(TARGETS, ys))
        if r == rounds:
            return models
        odds = cut(_log_odds(pool, models), "odds")
        chosen = marks(odds, {t: m.prior for t, m in zip(TARGETS, models)}, r, most)
        chosen = cut(chosen, "marks")
        # at most most rows for each of two classes, two views and two targets
        new = _columns(marked(pool, chosen), "what", "y", "dense", "words", "meta")
        what, y, f = np.array(new.column("what").to_pylist(), object), new.column("y").to_numpy().astype(float), Features.of(new)
        for t in TARGETS:
            for v, other in (("text", "meta"), ("meta", "text")):
                mine = np.flatnonzero(what == f"{t}_{v}")
                if len(mine):
                    was = told[t].get(other)
                    told[t][other] = (was[0] + f.rows(mine), np.concatenate((was[1], y[mine]))) if was else (f.rows(mine), y[mine])
    raise AssertionError


def train(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **options) -> tuple[Model, Model]:
    """Models of quality and of toxicity from docs and labels (doc_id, quality, toxic); options: those of co_train."""
    return co_train(features(docs, labels, pages), **options)


def scores(rows: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """doc_id, k, quality, toxic (probabilities) and kept for each row of the table of features."""
    sigmoid = lambda t, m: 1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), F.col(f"{t}_text") + F.col(f"{t}_meta") - F.lit(m.prior)))))
    odds = _log_odds(rows, models)
    named = odds.select("doc_id", "k", *[sigmoid(t, m).alias(t) for t, m in zip(TARGETS, models)])
    return named.withColumn("kept", (F.col("quality") >= KEEP) & (F.col("toxic") < TOXIC))


def _same_row(k: str) -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(k) == F.col("_row"))


def score(docs: DataFrame, models: tuple[Model, Model], pages: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """docs with quality, toxic (probabilities) and kept. Null and empty texts are scored as empty; columns of these names are
    replaced; every row stays, repeated ones too. rows: the features of docs, if they are there."""
    rows = features(docs, None, pages) if rows is None else rows
    docs = docs.drop("quality", "toxic", "kept")
    found = scores(rows, models).groupBy("doc_id", "k").agg(*[F.first(c).alias(c) for c in ("quality", "toxic", "kept")]).withColumnsRenamed({"doc_id": "_id", "k": "_row"})
    k = unused(docs, "_k")
    return docs.withColumn(k, _row_hash(docs)).join(found, _same_row(k), "left").select(*docs.columns, "quality", "toxic", "kept")


def keep(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The rows of docs that co-training on them keeps."""
    rows = features(docs, labels, pages)
    kept = scores(rows, co_train(rows)).filter("kept").select(F.col("doc_id").alias("_id"), F.col("k").alias("_row"))
    k = unused(docs, "_k")
    return docs.withColumn(k, _row_hash(docs)).join(kept, _same_row(k), "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of every document; texts are read once, and only features and scores travel."""
    rows = features(*(table(spark, sf_dir, t) for t in ("documents", "labels", "pages")))
    return scores(rows, co_train(rows)).select("doc_id", "quality", "toxic", "kept")
