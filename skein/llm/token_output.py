"""Token-id files: shards of ids under Re-Pair grammar compression, decodable from any document on.

Documents are dealt to partitions by ranges of their ids and encoded in that order. Each partition writes shards of
about SHARD_TOKENS ids. In a shard, pairs of ids that occur MIN_PAIRS times or more become nonterminals, again and again
until there are none; a pair never crosses the end of a document. A shard's bytes, all little-endian:

    4 bytes RPR1; uint32: documents, rules, symbols, first nonterminal
    rules x 2 uint32: the pair of each rule, in the order of their making
    rules x uint32: the expansion length of each rule
    (documents + 1) x uint32: where each document starts in the symbols
    symbols x uint32: ids and nonterminals

The shards are rows of a Parquet table (part, shard, ids before it in the part, tokens, doc_ids, body), so Spark's own writer commits them.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_set, heads, spread, word_spans
from .span_ids import SpanIds, gather

SHARD_TOKENS = 1 << 20
#: Pairs that occur so often are replaced, the most frequent of them in a round, in rounds until there are none.
MIN_PAIRS, RULES_A_ROUND = 64, 4096
#: Bytes of text in a block, and words that a worker keeps.
BLOCK_BYTES, WORDS = 1 << 22, 1 << 19
#: Marks that may stand behind a word and make one token group together.
_MARKS = "!#$%&*+,-./:;<=>?@|)"
#: White space that ends a word; any other is left to the library.
_SPACES = byte_set((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))


#: ASCII letters, what follows C3 in a letter of two bytes (all but the signs of times and division), and the marks.
_LETTERS, _AFTER_C3 = byte_set((0x41, 0x5A), (0x61, 0x7A)), byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
_MARK_BYTES = byte_set(*((ord(x), ord(x)) for x in _MARKS))
#: Words that go to the library in one string.
GROUP = 256


def token_groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for words of letters up to U+00FF, 2 for such with marks behind them, 0 for any other word."""
    letter, mark = _LETTERS[data], _MARK_BYTES[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & _AFTER_C3[data[1:]])
    letter[pair] = letter[pair + 1] = True
    back = letter.copy()  # a letter behind something else
    back[1:] &= ~letter[:-1]
    letters, others, turns = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (letter, ~(letter | mark), back))
    whole = letters[ends] - letters[starts] == ends - starts
    fits = letter[starts] & (others[ends] == others[starts]) & (turns[ends] == turns[starts + 1])
    return np.where(fits, np.where(whole, 1, 2), 0)


class WordIds(SpanIds):
    """Words by their kind: those of token_groups() are put together as bytes, others go to new()."""

    def __init__(self, own: WordEncoder) -> None:
        super().__init__(own._new, WORDS)
        self.groups = own.groups

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, ends = gather(data, starts, ends - starts)
        starts = np.append(0, ends[:-1])[: len(ends)]
        count = token_groups(data, starts, ends)
        plain, rest = np.flatnonzero(count), np.flatnonzero(count == 0)
        ids, size, failed = self.groups(data, starts[plain], ends[plain], count[plain])
        rest = np.concatenate([rest, plain[failed]])
        others, more = super()._encoded(data, starts[rest], ends[rest])
        place = np.empty(len(starts), np.int64)
        sizes = np.empty(len(starts), np.int64)
        sizes[plain], place[plain] = size, np.cumsum(size) - size
        sizes[rest], place[rest] = more, np.cumsum(more) - more + len(ids)
        return gather(np.concatenate([ids, others]), place, sizes)[0], sizes


class WordEncoder:
    """Ids of whole texts by the tokenizers library, a distinct word of a block at a time.

    The vocabulary drops white space before it merges, and neither its normaliser nor its pattern looks across it, so
    the ids of a text are those of its words put together. New words of letters, with a mark behind them or not, go to
    the library many in a string; its tokens that end a word tell where each ends. Added tokens such as <|endoftext|> hold
    no white space and no such word is only letters and marks, so their words go to the library whole and get their ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start threads for all of the machine's
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocabulary = self.own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.spans = WordIds(self)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.own.encode_batch_fast(words, add_special_tokens=False)]

    def groups(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that make one token group, or two, each: their ids one word after the other, how many each has, and the
        words of strings whose tokens end otherwise (their ids are left out)."""
        width = np.stack([ends - starts, np.ones(len(starts), np.int64)], 1).ravel()
        text, total = gather(np.append(data, np.uint8(0x20)), np.stack([starts, np.full(len(starts), len(data))], 1).ravel(), width)
        raw, stops, size = text.tobytes(), total[1::2], np.zeros(len(starts), np.int64)
        cuts = [*range(0, len(starts), GROUP), len(starts)] if len(starts) else [0]
        strings = [raw[stops[a - 1] if a else 0 : stops[b - 1] - 1].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
        out, failed = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b, got in zip(cuts, cuts[1:], self.own.encode_batch_fast(strings, add_special_tokens=False), strict=False):
            ids, last = np.array(got.ids, np.uint32), np.cumsum(count[a:b]) - 1
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != last[-1] + 1:  # a letter became something else in lower case
                failed.append(np.arange(a, b))
                continue
            size[a:b] = np.diff(stop[last], prepend=0)
            out.append(ids)
        return np.concatenate(out), size, np.concatenate(failed)

    def _new(self, raw: list[bytes]) -> list[bytes]:
        words = [w.decode("utf-8", "replace") for w in raw]
        count = [1 if w.isalpha() else 2 if w.rstrip(_MARKS).isalpha() else 0 for w in words]
        plain = [i for i, n in enumerate(count) if n]
        out: list[bytes] = [b""] * len(words)
        odd = [i for i, n in enumerate(count) if not n]
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        for group, got in zip(groups, self.own.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([count[i] for i in group]) - 1
            if len(cuts) != last[-1] + 1:  # a letter became something else in lower case
                odd += group
                continue
            cells, at = ids.tobytes(), 0
            for i, end in zip(group, (4 * cuts[last]).tolist(), strict=True):
                out[i], at = cells[at:end], end
        for i, ids in zip(odd, self._each([words[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each followed by end, and how many each row has."""
        starts, ends, first = word_spans(data, offsets, _SPACES)
        table, begin, size = self.spans.look_up(data, starts, ends)
        begin, size = np.insert(begin, first[1:], len(table)), np.insert(size, first[1:], 1)
        ids, total = gather(np.append(table, np.uint32(end)), begin, size)
        return ids, np.diff(np.concatenate([[0], total[first[1:] + np.arange(len(offsets) - 1)]]))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _slots(pair: np.ndarray) -> np.ndarray:
    """20 bits of each pair."""
    with np.errstate(over="ignore"):
        return pair * np.uint32(0x9E3779B1) >> np.uint32(12) if pair.dtype == np.uint32 else pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)


def compress(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Re-Pair: (symbols, each document's first symbol and the end, pair of each rule, expansion length of each rule, first
    nonterminal). No pair crosses the end of a document."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes, dtype=np.int64) - 1] = True
    base = int(seq.max()) + 1 if len(seq) else 0
    rules = np.zeros((0, 2), np.uint32)
    # where a pair may still be frequent: a replacement makes pairs of its new symbol, and any other pair only rarer
    live = ~last
    while len(at := np.flatnonzero(live)):
        top = base + len(rules)
        kind, half = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
        pair = seq[at].astype(kind) << kind(half) | seq[at + 1]
        ordered = np.sort(pair)
        head = heads(ordered)
        count = np.diff(np.append(head, len(ordered)))
        often = np.flatnonzero(count >= MIN_PAIRS)
        if not len(often):
            break
        value, chosen = ordered[head[often]], np.zeros(len(often), bool)
        chosen[np.argsort(-count[often], kind="stable")[:RULES_A_ROUND]] = True
        # most places hold no frequent pair; a table of hashes tells which are worth a search
        slot = _slots(pair)
        maybe = np.zeros(1 << 20, bool)
        maybe[_slots(value)] = True
        some = np.flatnonzero(maybe[slot])
        at, pair = at[some], pair[some]
        number = np.minimum(np.searchsorted(value, pair), len(value) - 1)
        found = value[number] == pair
        at, number = at[found], number[found]
        live[:] = False
        live[at] = True
        at, number = at[chosen[number]], (np.cumsum(chosen) - 1)[number[chosen[number]]]
        value = value[chosen].astype(np.uint64)
        mask = np.uint64((1 << half) - 1)
        value = np.stack([value >> np.uint64(half), value & mask], 1)
        # of places in a row every second one is taken, so that no two overlap
        new = np.concatenate([[True], np.diff(at) > 1])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at, number = at[run % 2 == 0], number[run % 2 == 0]
        seq[at] = (top + number).astype(np.uint32)
        last[at] = last[at + 1]
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq, last, live = seq[left], last[left], live[left]
        made = seq >= top
        live |= made
        live[:-1] |= made[1:]
        live &= ~last
        rules = np.concatenate([rules, value.astype(np.uint32)])
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1))
    return seq, np.concatenate([[0], np.flatnonzero(last) + 1]), rules, np.array(lengths, np.uint32), base


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols: each nonterminal gives way to its pair until none is left."""
    out = symbols
    while len(at := np.flatnonzero(out >= base)):
        wide = np.ones(len(out), np.int64)
        wide[at] = 2
        rule = out[at] - base
        first = (np.cumsum(wide) - wide)[at]
        out = np.repeat(out, wide)
        out[first], out[first + 1] = rules[rule, 0], rules[rule, 1]
    return out


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of a shard of documents with so many ids each, one at least."""
    symbols, starts, rules, lengths, base = compress(ids, sizes)
    head = np.array([len(sizes), len(rules), len(symbols), base])
    return b"RPR1" + b"".join(x.astype("<u4").tobytes() for x in (head, rules.ravel(), lengths, starts, symbols))


class Shard:
    """Random access to a packed shard."""

    def __init__(self, body: bytes) -> None:
        if bytes(body[:4]) != b"RPR1":
            raise ValueError("not a shard of token ids")
        data = np.frombuffer(body, "<u4", offset=4)
        n, k, m, self.base = (int(x) for x in data[:4])
        cuts = np.cumsum([4, 2 * k, k, n + 1, m])
        self.rules, self.sizes, self.starts, self.symbols = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.rules = self.rules.reshape(-1, 2)
        self.documents = n

    @functools.cached_property
    def ends(self) -> np.ndarray:
        """Ids before each symbol and behind the last, by the rules' expansion lengths."""
        width = np.append(self.sizes, 1)[np.where(self.symbols >= self.base, self.symbols.astype(np.int64) - self.base, -1)]
        return np.concatenate([[0], np.cumsum(width, dtype=np.int64)])

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, without decoding the others."""
        return expand(self.symbols[self.starts[i] : self.starts[i + 1]], self.rules, self.base)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at these places of the shard: of its symbols only those that reach into them are expanded."""
        start, stop = max(0, start), min(stop, int(self.ends[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = int(np.searchsorted(self.ends, start, "right")) - 1, int(np.searchsorted(self.ends, stop, "left"))
        return expand(self.symbols[first:last], self.rules, self.base)[start - int(self.ends[first]) :][: stop - start]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each document starts in them, by the rules' expansion lengths."""
        ids = expand(self.symbols, self.rules, self.base)
        if self.ends[-1] != len(ids):
            raise ValueError("the expansion does not have the length that its rules state")
        return ids, self.ends[self.starts]


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append the end id, and write the shards in ascending order of the key.

    A null text is empty, so its document is the end id alone. A null key stands first; rows with equal keys follow each
    other in the order of their texts. An empty table gives a table without shards. Other columns are ignored. The end id
    may also stand for text; a shard has the documents' bounds. Texts cross one shuffle, dealt by ranges of the key.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_output import encoder  # the worker's own cache

        own, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = before = 0

        def out() -> pa.RecordBatch:
            keys, ids, sizes = (list(x) for x in zip(*held, strict=True))
            keys = pa.ListArray.from_arrays([0, sum(map(len, keys))], pa.concat_arrays(keys))
            cells = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before]), pa.array([tokens]), keys, pa.array([pack(np.concatenate(ids), np.concatenate(sizes))], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, ["part", "shard", "before", "tokens", "doc_ids", "body"])

        for rows, data, offsets in blocks(batches, "text", BLOCK_BYTES):
            ids, sizes = own.encode(data, offsets, end)
            at = np.concatenate([[0], np.cumsum(sizes)])
            row = 0
            while row < len(sizes):
                stop = min(len(sizes), max(row + 1, int(np.searchsorted(at, at[row] + SHARD_TOKENS - tokens))))
                held.append((rows.column("key").slice(row, stop - row), ids[at[row] : at[stop]], sizes[row:stop]))
                tokens += int(at[stop] - at[row])
                row = stop
                if tokens >= SHARD_TOKENS:
                    yield out()
                    held, before, tokens, number = [], before + tokens, 0, number + 1
        if held:
            yield out()

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(spread(rows), "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(shards, "part int, shard int, before long, tokens long, doc_ids array<long>, body binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and, with_ids,
    the ids. What precedes a shard in its part is stored with it; what precedes a part is summed on the driver, from one
    row for each part (so many rows as the writing step had tasks)."""
    table = spark.read.parquet(path)
    before, total = [], 0
    for part, tokens in sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("tokens")).collect()):
        before.append((part, total))
        total += tokens
    base = F.broadcast(spark.createDataFrame(before, "part int, base long"))
    shards = table.join(base, "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "body")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, body in zip(batch.column("start").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("body"), strict=True):
                ids, at = Shard(body.as_buffer()).all()
                ids, at = ids.astype("<u4", copy=False), at.tolist()
                rows = [(k, start + a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None) for k, a, b in zip(keys, at, at[1:], strict=False)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.list_(pa.int64()),), strict=True)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 4 + with_ids], names[: 4 + with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.mapInArrow(documents, schema)
