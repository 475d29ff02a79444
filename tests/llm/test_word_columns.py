"""op3: ids of words are kept in columns."""

from __future__ import annotations

import random
import sys

import numpy as np
import public_tokenizers
import pytest

from cipherledger.llm import token_files as T


def _encode(tok: T.WordIds, texts: list[str]) -> list[list[int]]:
    data = [t.encode() for t in texts]
    ids, lens = tok.encode(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])), 1)
    return [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]


@pytest.mark.parametrize("remembered", [250_000, 40])
def test_words_equal_the_library_while_some_are_forgotten(monkeypatch, remembered):
    monkeypatch.setattr(T, "WORDS", remembered)
    rng, tok = random.Random(3), T.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    signs = list("abcdéß'’.,!?-_ 018  \n\t\u0085\x0b") + ["中", "Ᲊ", "ª", "́", "'ll", "ı", "𐐷"]
    for _ in range(4):
        texts = ["", " ", *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(300)), ""]
        assert _encode(tok, texts) == [[*e.ids, 1] for e in tok.tok.encode_batch(texts, add_special_tokens=False)]
        assert len(set(tok.known.to_pylist())) == len(tok.known) == len(tok.lens)
    assert _encode(tok, ["", ""]) == [[1], [1]]


def test_a_word_takes_no_step_of_python():
    rng, tok, calls = random.Random(5), T.WordIds(public_tokenizers.path("word_bpe_49k.json")), [0]
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) + rng.choice(["", ",", "."]) for _ in range(10_000)]

    def count(frame, event, arg):
        calls[0] += 1

    sys.setprofile(count)
    try:
        got = _encode(tok, [" ".join(words)])
    finally:
        sys.setprofile(None)
    assert got == [[*tok.tok.encode(" ".join(words), add_special_tokens=False).ids, 1]]
    assert calls[0] < len(words)
