"""Runs and long pieces without a space, against the library and within a time limit."""

from __future__ import annotations

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken


@pytest.fixture(scope="module")
def tree():
    from skein.llm.byte_bpe import TreeBpe

    return TreeBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})


def test_against_the_library(tree, library):
    rnd = random.Random(5)
    for alphabet in ("ab", "x", "xX ", "éßa", "the an in", "0123", " \n"):
        for _ in range(60):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 900)))
            assert tree.piece(text.encode()) == library.encode_ordinary(text), text
    for text in ("x" * 10_001, "ab" * 5001 + "a", "é" * 5001, "=-" * 7001):
        assert tree.piece(text.encode()) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 1_000_001, "ab" * 500_000 + "a", " " * 1_000_001, "".join(random.Random(1).choices("abcdefghijklmnop", k=1_000_001))], ids=["run", "pair", "space", "random"])
def test_a_million_bytes(tree, text):
    began = time.time()
    ids = tree.piece(text.encode())
    assert time.time() - began < 60
    assert tree.decode(ids) == text.encode()
    assert all(tree.stays(a, b) for a, b in zip(ids, ids[1:], strict=False))  # which is what an encoding is
