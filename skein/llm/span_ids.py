"""Token ids of many spans of text, each distinct span encoded once for a block and kept for later ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import LONG_SPAN, equal_spans, span_hashes

#: Distinct spans that a worker keeps, none longer than LONG_SPAN; those met first stay, which are the frequent ones.
CAPACITY = 1 << 18


class SpanIds:
    """Spans are looked up by 64-bit hashes and known by their bytes, which are kept and compared; a span whose hash
    belongs to another is encoded by itself, each time.

    new() encodes a list of spans, each the bytes of a text, to the bytes of uint32 ids.
    """

    def __init__(self, new: Callable[[list[bytes]], list[bytes]], capacity: int = CAPACITY) -> None:
        self.new, self.capacity = new, capacity
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # by entry, in the order of their coming: where its ids and its bytes begin in the two stores, and how many they are
        self.begin, self.size, self.at, self.width = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these spans, one span after the other, and how many each has."""
        raw = data.tobytes()
        cells = self.new([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(starts) else []
        return np.frombuffer(b"".join(cells), np.uint32), np.array([*map(len, cells)], np.int64) // 4

    def _learn(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray, width: np.ndarray, raw: np.ndarray) -> None:
        self.fresh.append((keys, size, ids, width, raw))
        if sum(len(x[0]) for x in self.fresh) * 5 > len(self.keys):
            keys, size, ids, width, raw = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            entry = np.arange(len(keys)) + len(self.size)
            self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.ids)])
            self.at = np.concatenate([self.at, np.cumsum(width) - width + len(self.raw)])
            self.size, self.width = np.concatenate([self.size, size]), np.concatenate([self.width, width])
            self.ids, self.raw = np.concatenate([self.ids, ids]), np.concatenate([self.raw, raw])
            keys, first = np.unique(keys, return_index=True)  # the first of a key stays, as what comes later is compared with it
            place = np.searchsorted(self.keys, keys)
            new = np.append(self.keys, 0)[place] != keys if len(self.keys) else np.ones(len(keys), bool)
            self.keys, self.entry = np.insert(self.keys, place[new], keys[new]), np.insert(self.entry, place[new], entry[first[new]])
            self.fresh = []

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and for each span where its ids begin in it and how many they are."""
        width = ends - starts
        keys, where, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        which = which.ravel()
        alike = where[which]  # the span that stands for each span's hash
        odd = np.flatnonzero((width != width[alike]) | ~equal_spans(data, starts, data, starts[alike], np.minimum(width, width[alike])))
        found, known = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0)), np.zeros(len(keys), bool)
        taken = known
        if len(self.keys):
            taken = self.keys[found] == keys
            entry = self.entry[found]
            known = taken & (self.width[entry] == width[where])
            some = np.flatnonzero(known)
            known[some] = equal_spans(data, starts[where[some]], self.raw, self.at[entry[some]], width[where[some]])
        fresh = np.flatnonzero(~known)
        asked = np.concatenate([where[fresh], odd])
        flat, more = self._encoded(data, starts[asked], ends[asked])
        first = np.cumsum(more) - more + len(self.ids)
        size, begin = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        if len(self.keys):
            size[known], begin[known] = self.size[entry[known]], self.begin[entry[known]]
        size[fresh], begin[fresh] = more[: len(fresh)], first[: len(fresh)]
        begin, size = begin[which], size[which]
        begin[odd], size[odd] = first[len(fresh) :], more[len(fresh) :]
        table = np.concatenate([self.ids, flat])
        learn = np.flatnonzero(~taken[fresh] & (width[where[fresh]] <= LONG_SPAN))
        if len(self.keys) < self.capacity and len(learn):
            mine = fresh[learn]
            kept = gather(flat, first[learn] - len(self.ids), more[learn])[0]
            self._learn(keys[mine], more[learn], kept, width[where[mine]], gather(data, starts[where[mine]], width[where[mine]])[0])
        return table, begin, size


def gather(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (or bytes) of the spans, one span after the other, and each span's end in them."""
    total = np.cumsum(size)
    return table[np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)], total
