"""Brute-force versions of the operators, and what compares rows with them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
BENCHMARK_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def differing(rows: dict, expected: dict) -> list:
    assert set(rows) == set(expected)
    return [(k, {c: (rows[k][c], v) for c, v in e.items() if rows[k][c] != v}) for k, e in expected.items() if any(rows[k][c] != v for c, v in e.items())][:5]


def base_counts(text: str) -> dict:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "base_failed": failed}


def removed(texts: list[tuple[int, bytes]], width: int = 100) -> dict[int, np.ndarray]:
    seen, out = set(), {}
    for k, raw in sorted(texts):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if (w := raw[i : i + width]) in seen:
                gone[i : i + width] = True
            else:
                seen.add(w)
        out[k] = gone
    return out


def removal_row(raw: bytes, gone: np.ndarray) -> dict:
    spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)
    kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": len(spans), "kept_sha256": sha(kept)}


def shingles(text: str, n: int = 5) -> set:
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def link_rows(texts: dict[int, str]) -> dict:
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: {"n_shingles": len(s), "component_id": find(k)} for k, s in sets.items()}


def contamination(texts: dict[int, str], items: list[tuple[str, str]]) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        words = BENCHMARK_WORD.findall(text.translate(LOWER))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for k, text in texts.items():
        words = BENCHMARK_WORD.findall(text.translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out[k] = {"n_words": len(words), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha(",".join(sorted(found))), "contaminated": bool(hit)}
    return out
