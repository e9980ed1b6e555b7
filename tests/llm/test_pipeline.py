"""The pipeline: each stage on what its predecessor kept, against what the stage promises."""

import corpus_pipeline
import pytest
from brute import components, dedup_lines, mix_targets, simhash, words

from siltstone.llm.common import cut, table
from siltstone.llm.line_dedup import MIN_WORDS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def made(spark, sf):
    docs = out = table(spark, sf, "documents")
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, out, sf), name)
        rows.append(out.collect())
    return rows


def test_stages(made):
    docs, scored, lines, near, mixed, packed = made
    assert all(set(r.asDict()) == set(COLUMNS) for rows in made[1:5] for r in rows)
    was = {r["doc_id"]: r for r in docs}
    assert 0.6 * len(docs) < len(scored) < len(docs) and all(was[r["doc_id"]] == r for r in scored)
    expected = dedup_lines(sorted((r["doc_id"], r["text"]) for r in scored), MIN_WORDS)
    assert {r["doc_id"]: r["text"] for r in lines} == expected and all(r["n_chars"] == len(r["text"]) for r in lines)
    groups = components({r["doc_id"]: simhash(r["text"]) for r in lines})
    assert sorted(r["doc_id"] for r in near) == sorted(set(groups.values()))
    sizes, taken = {}, {}
    for r in near:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    largest = max(len(words(r["text"])) for r in near)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in mix_targets(sizes).items())
    assert sum(r["start"] == 0 for r in packed) == len(mixed)


def test_run_is_the_last_stage(spark, sf, made):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, made[-1]))
