"""URL filter: glob rules packed into multiword Shift-And masks, all patterns simulated at once over each URL.

A glob is text with two wildcards: `*` stands for any run without `/`, `**` for any run. It is matched against
the whole canonical URL, `.` + host + path, so `*.net/es/**` fits the host net and every subdomain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: URLs that no rule fits are blocked if one of these fits, else allowed.
BLOCKED_GLOBS: tuple[str, ...] = ("**/login**", "**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.zip", "*.casino*/**", "*.porn*/**")


def parts(glob: str) -> list[str]:
    """A glob's wildcards and what stands between them."""
    return [x for x in re.split(r"(\*\*|\*)", glob) if x]


class GlobSet:
    """Masks of a set of globs. State j of a glob means that its first j literals are read; a wildcard is a loop on its state."""

    def __init__(self, globs: Sequence[str]) -> None:
        steps, accept, start = [], [], []
        loops: list[tuple[int, bool]] = []
        for glob in globs:
            raw, k = glob.encode(), 0
            start.append(len(steps))
            steps.append(-1)
            while k < len(raw):
                if raw[k : k + 1] == b"*":
                    double = raw[k : k + 2] == b"**"
                    loops.append((len(steps) - 1, double))
                    k += 1 + double
                else:
                    steps.append(raw[k])
                    k += 1
            accept.append(len(steps) - 1)
        self.words = (len(steps) + 63) // 64 or 1
        self.accept = np.array(accept, np.int64)
        self.initial = self._mask(start)
        self.step = np.stack([self._mask([j for j, x in enumerate(steps) if x == c]) for c in range(256)])
        anything, free = [j for j, double in loops if double], [j for j, _ in loops]
        self.stay = np.stack([self._mask(anything if c == ord("/") else free) for c in range(256)])

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A flag for each row and glob. The rows advance together, a byte at a time, until the longest ends."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        state = np.tile(self.initial, (len(order), 1))
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, "left"))
            byte, now = data[begin[:live] + k], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        hit = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """host, path, the longest fitting rule (or null) and the verdict of each URL.

    A null URL, or one without `://`, has an empty host and path, so no rule or glob fits and it is allowed. Ties in
    length go to the rule that comes first. Rows are judged one by one: repeated rows repeat, an empty table gives an
    empty one, other columns are ignored. Nothing is shuffled.
    """
    names = [host + path for _, host, path in rules]
    globs = [f"*.{host}{path}**" for _, host, path in rules] + list(blocked)
    by_length = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    verdicts = [x[0] for x in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                hit = automaton.match(*column_bytes(part.column("canonical")))
                best = np.full(part.num_rows, -1)
                for i in reversed(by_length):
                    best[hit[:, i]] = i
                bad = hit[:, len(rules) :].any(axis=1)
                rule = [names[i] if i >= 0 else None for i in best]
                verdict = [verdicts[i] if i >= 0 else "block" if b else "allow" for i, b in zip(best, bad, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), part.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substr({url}, instr({url}, '://') + 3)"), "#", 1)).otherwise("")
    parts = pages.select(F.col(key).alias("id"), F.substring_index(F.coalesce(rest, F.lit("")), "?", 1).alias("rest"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = parts.select("id", F.translate(F.substring_index("rest", "/", 1), upper, lower).alias("host"), F.expr("CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END").alias("path"))
    split = split.withColumn("canonical", F.when((F.col("host") == "") & (F.col("path") == ""), "").otherwise(F.concat(F.lit("."), "host", "path")))
    kind = pages.schema[key].dataType.simpleString()
    return split.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", key)
