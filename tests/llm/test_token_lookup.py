"""Chunks are looked up as arrays: equal hashes of other words, full tables and texts of all kinds give the library's ids."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import token_ids


@pytest.mark.parametrize("table", [None, 300])
@pytest.mark.parametrize("colliding", [False, True])
def test_lookup(monkeypatch, table, colliding):
    rng, alphabet = random.Random(9), [*"  aeßüéñxyzT.,;!?\n\t0-\u2003\u3000漢\x00\xa0µ", "<|endoftext|>", " word", ". ", "a" * 30]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", None, " ", ".", "a.", " a.", " a. ", " b.\n"]
    expected = [e.ids for e in Tokenizer.from_file(token_ids.default_vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    if table:
        monkeypatch.setattr(token_ids, "TABLE_CHUNKS", table)
        monkeypatch.setattr(token_ids, "_AT_ONCE", 1500)
    if colliding:
        monkeypatch.setattr(token_ids, "_mixed", lambda words: words[:, 0] % np.uint64(7))
    made = token_ids.Encoder(token_ids.default_vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in made.encode(texts)] == expected


def test_each_word_is_learned_once():
    """Marks after a word are entries of their own, so that a word is encoded once with and without them."""
    made = token_ids.Encoder(token_ids.default_vocabulary())
    list(made.encode([" thenonce, thenonce. thenonce thenonce! another, another. another another!"]))
    assert made.n_starts == 5
