"""Byte-level BPE by monoid tree reduction, with ids equal to those of a rank file's own library.

A piece of text is encoded by halves. Two encoded neighbours are joined by encoding a window of tokens around their
seam again; it doubles to the left until the tokens outside provably stay, and moves on to the right until the seam to
what is left does. The proof: merges go by rank, leftmost first, and the first merge across a token boundary would also
happen in the two tokens alone. So a sequence is the encoding of its bytes if and only if each pair of neighbours is the
encoding of its own bytes; runs of an encoding are encodings. Hence only the window's two outer seams need a look, and
what a window has settled need not be encoded again when the next one starts behind it. A window takes as many tokens
from the right as the last one took from the left, so that a join encodes no more than a few times its tokens: a run of
one character costs its length times the depth of the tree. The trees of many short pieces are reduced together in numpy,
a level of all at a time; there a window takes all tokens of both halves, so it has no outer seams. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct, mix
from .span_ids import SpanIds, gather

#: Bytes up to which merges are applied to a piece directly, and ids up to which bytes are put together directly.
LEAF_BYTES, LEAF_IDS = 8, 256
#: Encoded pieces that a worker keeps, for new units made of known pieces, and the characters that such a piece may have.
CACHE_PIECES, CACHE_CHARS = 50_000, 64
#: Bytes up to which pieces are reduced with others, how many at a time, and log2 of the seams that a worker keeps for them.
BATCH_BYTES, BATCH_PIECES, SEAM_BITS = 32, 1 << 13, 18
#: Bytes up to which the next merge is looked for in all pairs; longer windows keep their pairs in a heap.
SHORT_BYTES = 64


class Forest:
    """Trees of many short pieces at a time. A matrix has a column of ids for each piece, -1 behind its end."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: list[bytes]) -> None:
        self.none = len(bytes_of)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()] + [self.none], np.int64)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte_pair = self.pair(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.spelt = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.width = np.array([*map(len, bytes_of)], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.seam, self.stays = np.full(1 << SEAM_BITS, -1, np.int64), np.zeros(1 << SEAM_BITS, bool)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two tokens make, none if that is no token or there is no second one."""
        key = (left << 32) + right
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.rank[place], self.none)

    def merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of data[start : start + size], and how many ids each has: in a round the lowest-ranked pair of each
        column merges, the leftmost of equals. So each column that goes on loses a row in a round."""
        high = int(size.max()) if len(size) else 0
        out, left = np.full((high, len(size)), -1, np.int64), size.copy()
        if not high:
            return out, left
        row = np.arange(high)[:, None]
        raw = data[np.minimum(starts + row, len(data) - 1)].astype(np.int64)
        ids = np.where(row < size, self.byte[raw], -1)
        # the rank of each pair, with its row in the lowest bits
        ranks = np.where(row[1:] < size, self.byte_pair[raw[:-1] << 8 | raw[1:]], self.none) << 6 | row[:-1]
        mine, none = np.arange(len(size)), self.none << 6
        while True:
            best = ranks.min(axis=0) if len(ranks) else np.full(len(mine), none)
            ends = best >= none
            out[: len(ids), mine[ends]] = ids[:, ends]
            if ends.all():
                return out, left
            goes = ~ends
            mine, best, ids, ranks = mine[goes], best[goes], ids[:, goes], ranks[:, goes]
            left[mine] -= 1
            i, new, column = best & 63, best >> 6, np.arange(len(mine))
            ids = np.where(row[: len(ids) - 1] > i, ids[1:], ids[:-1])
            ids[i, column] = new
            ranks = np.where(row[: len(ranks) - 1] >= i, ranks[1:] - 1, ranks[:-1])
            some = np.flatnonzero(i > 0)
            ranks[i[some] - 1, some] = self.pair(ids[i[some] - 1, some], new[some]) << 6 | i[some] - 1
            some = np.flatnonzero(i < len(ranks))
            ranks[i[some], some] = self.pair(new[some], ids[i[some] + 1, some]) << 6 | i[some]

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Flags pairs of neighbours that are the encoding of their own bytes. Those met last are kept."""
        key = (left << 32) + right
        slot = (mix(key) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
        known = self.seam[slot] == key
        out = self.stays[slot]
        if len(ask := np.flatnonzero(~known)):
            keys, first, which = np.unique(key[ask], return_index=True, return_inverse=True)
            a, b, place = left[ask[first]], right[ask[first]], slot[ask[first]]
            data, total = gather(self.spelt, np.stack([self.at[a], self.at[b]], 1).ravel(), np.stack([self.width[a], self.width[b]], 1).ravel())
            size = self.width[a] + self.width[b]
            ids, n = self.merged(data, total[1::2] - size, size)
            fine = (n == 2) & (ids[0] == a) & (ids[1] == b)
            out[ask] = fine[which.ravel()]
            place, one = np.unique(place, return_index=True)
            self.seam[place], self.stays[place] = keys[one], fine[one]
        return out

    def trees(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What merged() gives, by halves: those whose seam does not stay are encoded again."""
        big = np.flatnonzero(size > LEAF_BYTES)
        if not len(big):
            return self.merged(data, starts, size)
        small, half = np.flatnonzero(size <= LEAF_BYTES), size[big] // 2
        ids, n = self.trees(data, np.concatenate([starts[small], starts[big], starts[big] + half]), np.concatenate([size[small], half, size[big] - half]))
        high, s, b, column = len(ids), len(small), len(big), np.arange(len(big))
        (one, n_one), (two, n_two) = (ids[:, s : s + b], n[s : s + b]), (ids[:, s + b :], n[s + b :])
        both = np.full((2 * high, b), -1, np.int64)
        both[:high] = one
        for j in range(high):
            some = np.flatnonzero(n_two > j)
            both[n_one[some] + j, some] = two[j, some]
        total = n_one + n_two
        again = np.flatnonzero(~self.stay(one[n_one - 1, column], two[0]))
        window, total[again] = self.merged(data, starts[big[again]], size[big[again]])
        both[:, again] = -1
        both[: len(window), again] = window[: 2 * high]
        out, left = np.full((2 * high, len(size)), -1, np.int64), np.empty(len(size), np.int64)
        out[:high, small], left[small], out[:, big], left[big] = ids[:, :s], n[:s], both, total
        return out, left


class TreeBpe:
    """Encoder and decoder for a file of ranks: a base64 token and its rank on each line."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.stays = functools.lru_cache(maxsize=1 << 16)(self._stays)
        self.window = functools.lru_cache(maxsize=1 << 14)(lambda raw: tuple(self._merged(raw)))

    def _merged(self, raw: bytes) -> list[int]:
        """The lowest-ranked pair of neighbours merges, the leftmost of equals, until none has a rank."""
        if len(raw) > SHORT_BYTES:
            return self._heaped(raw)
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = len(self.bytes_of)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[x] for x in parts]

    def _heaped(self, raw: bytes) -> list[int]:
        """The same merges, with the pairs in a heap and the parts in a linked list. A pair whose parts have changed since
        is known by its end and passed over."""
        get, n = self.ranks.get, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(raw[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, stop = heapq.heappop(pairs)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (rank := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(pairs, (rank, i, end[stop]))
            if i and (rank := get(raw[before[i] : stop])) is not None:
                heapq.heappush(pairs, (rank, before[i], stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : end[at]]])
            at = end[at]
        return out

    def _stays(self, left: int, right: int) -> bool:
        return self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings put together."""
        out, at, step, spell = left, 0, 1, self.bytes_of.__getitem__
        while out and at < len(right) and not self.stays(out[-1], right[at]):
            ahead, i = b"".join(map(spell, right[at : at + step])), 1
            while True:
                i = min(i, len(out))
                raw = b"".join(map(spell, out[len(out) - i :])) + ahead
                window = self.window(raw) if len(raw) <= SHORT_BYTES else self._merged(raw)
                if i == len(out) or self.stays(out[-i - 1], window[0]):
                    break
                i *= 2
            if out is left:
                out = list(left)
            out[len(out) - i :] = window
            at, step = at + step, i
        return out + right[at:]

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES:
            return self._merged(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    @functools.cached_property
    def forest(self) -> Forest | None:
        """None for ranks that lack a byte."""
        return Forest(self.ranks, self.bytes_of) if all(bytes([i]) in self.ranks for i in range(256)) else None

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """What piece() gives for each, as bytes of uint32 ids."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, raw in enumerate(pieces):
            if 2 < len(raw) <= BATCH_BYTES and raw not in self.ranks and self.forest:
                short.append(i)
            else:
                out[i] = array("I", self.piece(raw)).tobytes()
        short.sort(key=lambda i: len(pieces[i]))
        for k in range(0, len(short), BATCH_PIECES):
            some = [pieces[i] for i in short[k : k + BATCH_PIECES]]
            size = np.array([*map(len, some)], np.int64)
            ids, n = self.forest.trees(np.frombuffer(b"".join(some), np.uint8), np.cumsum(size) - size, size)
            flat, at = ids.T[ids.T >= 0].astype(np.uint32).tobytes(), 0
            for i, stop in zip(short[k : k + BATCH_PIECES], np.cumsum(4 * n).tolist(), strict=True):
                out[i], at = flat[at:stop], stop
        return out

    def piece(self, raw: bytes) -> list[int]:
        """A piece that is a token as a whole is that token; any other is merged."""
        return [self.ranks[raw]] if raw in self.ranks else self.tree(raw)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids: those of each half, put together."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: Patterns that unit_starts holds for. Under any other, a text is one unit.
SPACED_PATTERNS = (public_tokenizers.PATTERN,)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places that no match of the pattern crosses: row starts, and spaces with a character on either side that is surely
    no white space (ASCII that prints, or two bytes from C3 up). What is between them is matched and encoded by itself."""
    n = len(data)
    lead = (data >= 0xC3) & (data <= 0xDF)
    prints = (data > 0x20) & (data < 0x7F)
    before = prints.copy()
    before[1:] |= lead[:-1]
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & (prints | lead)[2:]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class TextEncoder:
    """Texts to ids, each match of a pattern by itself."""

    def __init__(self, path: str, pattern: str) -> None:
        self.bpe, self.split, self.spaced = TreeBpe(path), regex.compile(pattern).findall, pattern in SPACED_PATTERNS
        self.names = [str(i) for i in range(len(self.bpe.bytes_of))]
        self.pieces: dict[str, bytes] = {}
        self.spans = SpanIds(self._new)

    def _new(self, units: list[bytes]) -> list[bytes]:
        split, known = self.split, self.pieces
        found = [split(u.decode("utf-8", "replace")) for u in units]
        new = list({x: None for some in found for x in some if x not in known})
        ids = dict(zip(new, self.bpe.many([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))
        room = CACHE_PIECES - len(known)
        known.update([(x, i) for x, i in ids.items() if len(x) <= CACHE_CHARS][:room] if room > 0 else [])
        piece = (known | ids).__getitem__
        return [b"".join(map(piece, some)) for some in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin and the last end."""
        starts = unit_starts(data, offsets) if self.spaced else distinct(offsets[:-1][np.diff(offsets) > 0])
        ids, total = gather(*self.spans.look_up(data, starts, np.append(starts[1:], len(data))))
        return ids, np.append(0, total)[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process, so that what it has met serves all its tasks."""
    return TextEncoder(path, pattern)


def encode_documents(documents: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids
    decode to) and, with_ids, the ids.

    A null text is empty: no tokens, both digests of nothing. Repeated rows repeat, an empty table gives an empty one,
    other columns are ignored. ranks is a file that is installed on every executor. Nothing is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import encoder  # the module's own cache, which a pickled global would not be

        own = encoder(ranks, pattern)
        name = own.names.__getitem__
        for rows, data, offsets in blocks(batches, "text"):
            ids, at = own.encode(data, offsets)
            said, decoded = [], []
            for a, b in zip(at, at[1:], strict=False):
                some = ids[a:b].tolist()
                said.append(hashlib.sha256(",".join(map(name, some)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.bpe.decode(some)).hexdigest())
            columns = [rows.column("id"), pa.array(np.diff(at)), pa.array(said), pa.array(decoded)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", key)
