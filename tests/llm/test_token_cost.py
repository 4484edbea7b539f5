"""What op10's tasks cost: threads beside their own, and pairs that are counted again and again."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

WORDS = """
import os, sys
import numpy as np
from skein.llm.token_output import encoder
words = b" ".join(b"w" + bytes(97 + int(c) for c in str(i)) for i in range(20_000))
before = len(os.listdir("/proc/self/task"))
encoder(sys.argv[1]).encode(np.frombuffer(words, np.uint8), np.array([0, len(words)]), 1)
print(len(os.listdir("/proc/self/task")) - before)
"""


@pytest.mark.skipif(not os.path.isdir("/proc/self/task") or os.cpu_count() == 1, reason="threads can't be counted here")
def test_a_task_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    found = subprocess.run([sys.executable, "-c", WORDS, public_tokenizers.path("word_bpe_49k.json")], env=env, capture_output=True, text=True, check=True)
    assert int(found.stdout) == 0


def test_only_pairs_that_may_be_frequent_are_counted_again(monkeypatch):
    from skein.llm import token_output

    # half the ids are a phrase that takes rounds of rules, the others make rare pairs
    rnd = np.random.default_rng(7)
    rare, phrase = rnd.integers(1000, 40_000, 100_000), np.tile(np.arange(64), 1600)[:100_000]
    ids, counted = np.stack([rare.reshape(-1, 1000), phrase.reshape(-1, 1000)], 1).ravel().astype(np.uint32), []
    sort = np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **b: counted.append(len(x)) or sort(x, *a, **b))
    symbols, starts, rules, lengths, base = token_output.compress(ids, np.array([150_000, 50_000]))
    assert np.array_equal(token_output.expand(symbols, rules, base), ids) and lengths.max() >= 32
    assert len(counted) > 5 and sum(counted) < 2.5 * len(ids)


def test_odd_words_against_the_library():
    from tokenizers import Tokenizer

    from skein.llm.token_output import WordEncoder

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    some = [*"abzAZ éÉßñ×÷ÿÀ!#.,)( |09'’中İıǅſḰ\t\n\r\x0b  <>", "<|endoftext|>", "it's", "...", "ﬁ", "K", "\U0001f600"]
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 80))) for _ in range(800)] + ["", "a" * 1000, "é" * 600]
    raw = [t.encode() for t in texts]
    own, library = WordEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # new words, then known ones
        ids, sizes = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        found = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), ids).to_pylist()
        assert found == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
