"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

Texts are cut, with a space before them, into units that neither tokenizer's tokens cross (see byte_bpe.unit_starts; the
second one's vocabulary has no piece with a space behind other characters, which is checked). Each distinct unit is
tokenized once for a block and kept for later ones, and checked to be spelled out by the tokens of both. The token ends of a
block of texts are then marked in two packed bitsets; their AND has the shared cuts; counts of the bits up to a cut (rank,
by prefix sums of popcounts) say which tokens of either end there, so that cuts become groups of tokens and links between
tokens that end together.

Tokens are made once: what is kept of a document, in a table of the shared folder, is its counts, the digest of its groups
and its links as packed id pairs. Pairs are counted from that table, in each task first. The number of different pairs is
bounded by the vocabularies' product alone, so the table of counts is taken in blocks of at most BLOCK_PAIRS, each broadcast
and added up by a pass over the links; most corpora need one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import unit_starts
from .common import blocks, column_bytes, discard, saved
from .span_ids import SpanIds, gather

#: Id pairs whose counts a task holds at a time, pairs that a counting task holds before it gives them out, units that a
#: worker keeps, and bytes of text that it aligns together (some 60 bytes of arrays for each).
BLOCK_PAIRS, HELD_PAIRS, UNITS, ALIGNED_BYTES = 1 << 21, 1 << 22, 1 << 18, 1 << 20
_SPACE = "▁"
#: The cell of a unit that one of the tokenizers does not give back byte for byte.
_BAD = np.uint32(0xFFFFFFFF)


class Bits:
    """A packed bitset over places 0 .. size - 1, with ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set at or before each place."""
        counts = np.bitwise_count(self.words).astype(np.int64)
        before = np.cumsum(counts) - counts
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return before[word] + np.bitwise_count(self.words[word] & mask)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenizations of the same bytes, given by the byte behind each token (ascending, none empty): the bytes
    behind which tokens of both end, and how many tokens of either end at or before each of them."""
    size = int(ends_a[-1]) if len(ends_a) else 0
    a, b = Bits.of(ends_a - 1, size), Bits.of(ends_b - 1, size)
    cuts = (a & b).places()
    return cuts + 1, a.rank(cuts), b.rank(cuts)


class Tokens:
    """What tokens are spelled like: all their bytes, one after the other, and where each begins."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.size = np.array([*map(len, spelled)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.begin[ids], self.size[ids])[0]


def _spelled_out(tokens: Tokens, ids: np.ndarray, counts: np.ndarray, spans: list[bytes]) -> np.ndarray:
    """Flags the spans that are the bytes of their tokens, counts of each in ids."""
    width = np.array([*map(len, spans)], np.int64)
    total = np.append(0, np.cumsum(tokens.size[ids]))
    end = np.cumsum(counts)
    good = total[end] - total[end - counts] == width
    mine = tokens.spell(ids[np.repeat(good, counts)])
    theirs = np.frombuffer(b"".join([s for s, g in zip(spans, good.tolist(), strict=True) if g]), np.uint8)
    own = np.flatnonzero(good)
    good[np.repeat(own, width[own])[mine != theirs]] = False
    return good


class Aligner:
    """Two tokenizers and the units met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path_a)
        byte_of = _bytes_of_letters()
        entries = {i: bytes(map(byte_of.__getitem__, t)) for t, i in own.get_vocab(with_added_tokens=False).items()}
        self.a = _ranked(path_a, entries) or _plain(own)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("the second tokenizer has pieces with a space behind other characters")
        spelled_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.tokens_a, self.tokens_b = Tokens(spelled_a), Tokens(spelled_b)
        self.vocabulary_b = len(spelled_b)
        #: the smallest type that holds a pair as id of A * vocabulary of B + id of B
        self.pair_type = np.dtype("<u4" if len(spelled_a) * len(spelled_b) < 1 << 32 else "<u8")
        self.said = Tokens([f"{i}{end}".encode() for n, ends in ((len(spelled_a), ",|"), (len(spelled_b), ",;")) for end in ends for i in range(n)])
        self.spans = SpanIds(self._new, UNITS)

    def _new(self, spans: list[bytes]) -> list[bytes]:
        """Tokenizes the spans, each with a space in front: how many tokens of A, those, and those of B."""
        texts = [s.decode("utf-8", "replace") for s in spans]
        every = self.a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)
        counts = [np.array([*map(len, ids)], np.int64) for ids in every]
        flat = [np.array([x for one in ids for x in one], np.uint32) for ids in every]
        good = _spelled_out(self.tokens_a, flat[0], counts[0], spans) & _spelled_out(self.tokens_b, flat[1], counts[1], spans)
        end = np.cumsum(1 + counts[0] + counts[1])
        begin = end - 1 - counts[0] - counts[1]
        cells = np.empty(int(end[-1]), np.uint32)
        cells[begin] = np.where(good, counts[0], _BAD)
        for ids, n, first in ((flat[0], counts[0], begin + 1), (flat[1], counts[1], begin + 1 + counts[0])):
            total = np.cumsum(n)
            cells[np.repeat(first - total + n, n) + np.arange(len(ids))] = ids
        raw = cells.tobytes()
        return [raw[4 * p : 4 * q] for p, q in zip(begin.tolist(), end.tolist(), strict=True)]

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Of texts: per row the numbers of tokens of A, of B and of groups, and the digests of the groups; the pairs of all
        rows, one after the other."""
        rows = len(offsets) - 1
        data, offsets = spaced(data, offsets)
        starts = unit_starts(data, offsets)
        width = np.append(starts[1:], len(data))[: len(starts)] - starts
        table, begin, size = self.spans.look_up(data, starts, starts + width)
        n_a = table[begin]
        row = np.searchsorted(offsets, starts, "right") - 1
        good = np.ones(rows, bool)
        good[row[n_a == _BAD]] = False
        use = good[row]
        begin, size, row, width, n_a = begin[use], size[use], row[use], width[use], n_a[use].astype(np.int64)
        a, b = (gather(table, first, n)[0].astype(np.int64) for first, n in ((begin + 1, n_a), (begin + 1 + n_a, size - 1 - n_a)))
        ends_a, ends_b = np.cumsum(self.tokens_a.size[a]), np.cumsum(self.tokens_b.size[b])
        cuts, rank_a, rank_b = align(ends_a, ends_b)
        edge = np.append(0, np.cumsum(np.bincount(row, width, rows).astype(np.int64)))  # each row's bytes, bad rows left out
        counts = [np.diff(np.searchsorted(x, edge, "right")) for x in (ends_a, ends_b, cuts)]
        # the groups as text: A's tokens of a group stand behind B's of the groups before, B's behind A's of this one too
        of_a, of_b = np.diff(rank_a, prepend=0), np.diff(rank_b, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last[0][rank_a - 1], last[1][rank_b - 1] = True, True
        v_a, v_b = len(self.tokens_a.size), self.vocabulary_b
        order[np.arange(len(a)) + np.repeat(rank_b - of_b, of_a)] = a + v_a * last[0]
        order[np.arange(len(b)) + np.repeat(rank_a, of_b)] = 2 * v_a + b + v_b * last[1]
        raw = self.said.spell(order).tobytes()
        place = np.append(0, np.cumsum(self.said.size[order]))[np.append(0, np.cumsum(counts[0] + counts[1]))].tolist()
        digests = [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(place, place[1:], strict=False)]
        return counts, digests, (a[rank_a - 1] * v_b + b[rank_b - 1]).astype(self.pair_type)


def _plain(own):
    """Ids of texts by the tokenizers library."""
    own.encode_special_tokens = True  # their strings in a text are text
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def _ranked(path: str, entries: dict[int, bytes]):
    """Ids of texts by the same vocabulary's file of ranks, where one lies beside a byte-level vocabulary's own: the same
    ids in a third of the time. None if there is no such file, or if its tokens are not the same."""
    import tiktoken

    try:
        with open(f"{path.removesuffix('.json')}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    except FileNotFoundError:
        return None
    if ranks != {t: i for i, t in entries.items()}:
        return None
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [*map(own.encode_ordinary, texts)]


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printing Latin-1 characters for themselves, the
    other bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space in front of each that is not empty."""
    more = (np.diff(offsets) > 0).astype(np.int64)
    shift = np.cumsum(more)
    out = np.full(len(data) + int(shift[-1] if len(shift) else 0), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
    return out, offsets + np.append(0, shift)


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, so that what it has met serves all its tasks."""
    return Aligner(path_a, path_b)


_MEASURES = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _tokenized(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_alignment import aligner  # the module's own cache, which a pickled global would not be

        own = aligner(path_a, path_b)
        for rows, data, offsets in blocks(batches, "text", ALIGNED_BYTES):
            counts, digests, pairs = own.measure(data, offsets)
            end = pairs.itemsize * np.append(0, np.cumsum(counts[2]))
            links = pa.Array.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(pairs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("id"), *map(pa.array, counts), pa.array(digests), links], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def _pairs(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows, and where each row's begin and the last end."""
    data, offsets = column_bytes(column)
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), offsets // kind.itemsize


def _counted(kind: np.dtype):
    """Pairs of each task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, which = np.unique(np.concatenate([p for p, _ in held] or [np.zeros(0, np.int64)]), return_inverse=True)
            return pair, np.bincount(which.ravel(), np.concatenate([n for _, n in held] or [np.zeros(0)]), len(pair)).astype(np.int64)

        for batch in batches:
            held.append(np.unique(_pairs(batch.column("links"), kind)[0], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["pair", "n"])

    return run


def _gained(kind: np.dtype, counts: Broadcast):
    """Adds to n_best and count_sum what the pairs of a block of counts give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = counts.value
        for batch in batches:
            links, at = _pairs(batch.column("links"), kind)
            place = np.minimum(np.searchsorted(pair, links), max(0, len(pair) - 1))
            hit = pair[place] == links if len(pair) else np.zeros(len(links), bool)
            for name, x in (("n_best", best), ("count_sum", n)):
                more = np.diff(np.append(0, np.cumsum(np.where(hit, x[place], 0) if len(pair) else hit))[at])
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(np.array(batch.column(name)) + more))
            yield batch

    return run


def align_documents(documents: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per document: n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair is one of its second id's most
    frequent), count_sum (of the pairs' counts over the links) and groups_sha256 (of the groups as `a1,a2|b1;a3|b2,b3`).

    A null or empty text has no tokens: zeros and an empty groups_sha256; so has one that either tokenizer does not give
    back byte for byte. Repeated rows repeat and count each time; an empty table gives an empty one; other columns are
    ignored. Documents are not shuffled; pairs are, with their counts, once a task. The tokenizers' files are installed on
    every executor.
    """
    spark, kind = documents.sparkSession, documents.schema[key].dataType.simpleString()
    own = aligner(path_a, path_b)
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_tokenized(path_a, path_b), f"id {kind}, {_MEASURES}")
    tokens = saved(rows, "tokens")
    pairs = saved(tokens.select("links").mapInArrow(_counted(own.pair_type), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % own.vocabulary_b).alias("b")
    most = pairs.groupBy(b).agg(F.max("n").alias("most"))
    counts = saved(pairs.select("pair", "n", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "link_counts")
    number = max(1, -(-counts.count() // block_pairs))
    out = tokens.select("id", "n_a", "n_b", "n_groups", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256", "links")
    for k in range(number):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(number)) == k).toArrow()
        columns = [np.array(part.column(c)) for c in ("pair", "n", "best")]
        by = np.argsort(columns[0])
        out = out.mapInArrow(_gained(own.pair_type, spark.sparkContext.broadcast(tuple(c[by] for c in columns))), out.schema)
    discard(pairs, counts)
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
