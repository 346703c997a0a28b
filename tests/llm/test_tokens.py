"""The shared encoder: ids as the library gives them, one lookup for each different piece of a batch."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyfold.llm import queries
from tallyfold.llm.tokens import Encoder

PATHS = [(queries.vocabulary(queries.BYTES), False), (queries.vocabulary(queries.WORDS), True)]
BITS = ["a", "Word", "word", "ÉCLAIR", "été", "İ", "İ,", "Σ", "ΑΣ", "σς.", "日本", "ƻ", "aƻ", "ª", "Å", "Å", ",", "...", "x,", "X."]
BITS += ["it's", "IT'S", "a1", "<|endoftext|>", "<", "<|startoftext|>", "\x1c", "\x1f", "\x00", "😀", "​", "ﬁ", "Привет,", "ПРИВЕТ.", "\xad"]
SPACES = [" "] * 30 + ["\n"] * 5 + ["  ", "\n\n", "\t", "\r\n", " \n", "\n ", "\x0b", "\x85", "\xa0", " ", "　", "", ""]


@pytest.mark.parametrize("most", [30, 600_000])
@pytest.mark.parametrize(("path", "words"), PATHS)
def test_odd_texts_as_by_the_library(path, words, most):
    rnd = random.Random(most)
    own = Encoder(path, words, most)
    for plain in (True, False) * 20:
        spaces = [" ", "\n"] if plain else SPACES
        texts = ["".join(rnd.choice(BITS) + rnd.choice(spaces) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(0, 30))]
        wanted = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == wanted


class Asked(dict):
    """A dictionary that counts what it is asked for."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __missing__(self, key):
        raise KeyError(key)


@pytest.mark.parametrize(("path", "words"), PATHS)
def test_one_lookup_for_each_different_piece_of_a_batch(path, words):
    own = Encoder(path, words)
    own.encode(["one two three. one"])
    own.store = Asked(own.store)
    own.encode(["one two three. one two " * 1000] * 3)
    assert 0 < own.store.asked < 30
