"""Copies of a text in the classifier's rounds: they are one mark, and what the driver gathers is bounded whatever their number."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import classifier
from siltstone.llm.common import cut

COPIES, MOST = 60, 5
GOOD, JUNK = ("the river runs through a quiet valley", "a letter came from the old harbour"), ("$$ buy *** now $$ click ### here", "free ||| cash $$$ win >>> big <<<")


@pytest.fixture(scope="module")
def rows(spark):
    """40 labelled documents, and 20 texts without labels of which each is there COPIES times."""
    texts = [(GOOD if i % 2 else JUNK)[i // 2 % 2] + f" word{i}" for i in range(60)]
    source = lambda i: "book" if i % 2 else "web"
    docs = [(i, texts[i], "en", source(i), len(texts[i])) for i in range(40)]
    docs += [(1000 * i + c, texts[i], "en", source(i), len(texts[i])) for i in range(40, 60) for c in range(COPIES)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    return classifier.features(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels)


def test_marks_are_different_texts(spark, rows):
    models = classifier.co_train(rows, rounds=0)
    pool = rows.filter("quality IS NULL")
    odds = cut(classifier._log_odds(pool, models), "odds")
    chosen = classifier.marks(odds, {t: m.prior for t, m in zip(classifier.TARGETS, models)}, 0, MOST).collect()
    assert chosen and len(chosen) == len(set(chosen))
    assert max(Counter((r["what"], r["y"]) for r in chosen).values()) == MOST


def test_gathered_rows_are_bounded(rows, monkeypatch):
    gathered, columns = [], classifier._columns
    monkeypatch.setattr(classifier, "_columns", lambda df, *names: gathered.append(columns(df, *names)) or gathered[-1])
    classifier.co_train(rows, most=MOST, rounds=2)
    sample, *told = gathered
    assert sample.num_rows == 40 and len(told) == 2
    assert all(0 < t.num_rows <= MOST * 2 * len(classifier.VIEWS) * len(classifier.TARGETS) for t in told)


def test_rows_are_unpacked_in_little_memory():
    """4000 rows of 1000 buckets of 4 bytes; while they are put together they are there twice."""
    rng = np.random.default_rng(3)
    raw = [classifier.packed(np.unique(rng.integers(0, classifier.WORD_BUCKETS, 1000))) for _ in range(4000)]
    steps, lengths = np.frombuffer(b"".join(raw), "<u2"), np.array([len(x) // 2 for x in raw])
    tracemalloc.start()
    try:
        got = classifier.unpacked(steps, lengths)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(got.flat) == lengths.sum() and held < 5 * len(steps)
    assert peak < 10 * len(steps)
