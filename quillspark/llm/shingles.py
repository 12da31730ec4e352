"""Word and shingle hashes of texts, with numpy; used inside executors' tasks."""

from __future__ import annotations

import re
import sys
import types

import numpy as np

WORDS = 5
SEGMENT = 1 << 21
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def worker() -> dict:
    """What a worker process keeps between its tasks; functions come anew with each task."""
    return sys.modules.setdefault("quillspark_worker", types.ModuleType("quillspark_worker")).__dict__


class Hasher:
    """Hashes of words; powers are kept for the longest segment seen in the task."""

    def __init__(self) -> None:
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.gap = re.compile(rb"[\x20\x09-\x0d]")
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = pow(BASE, -1, 1 << 64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", BASE), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def words(self, data: bytes) -> np.ndarray:
        """A hash for each word [^\\x20\\x09-\\x0D]+ of the bytes, in order."""
        out, at = [], 0
        while len(data) - at > SEGMENT and (m := self.gap.search(data, at + SEGMENT)):
            out.append(self._words(data[at : m.start()]))
            at = m.start()
        out.append(self._words(data[at:]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _words(self, data: bytes) -> np.ndarray:
        return self.words_at(np.frombuffer(data, np.uint8))[0]

    def words_at(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, first bytes and ends of one buffer."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space[raw], [True])).view(np.int8)))
        if not len(edge):
            return np.zeros(0, np.uint64), edge, edge
        self.powers(len(raw))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bytes[raw] * self.up[: len(raw)])))
        first, last = edge[::2], edge[1::2]
        return mix((total[last] - total[first]) * self.down[first]), first, last

    def shingles(self, text: str | None, words: int = WORDS) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles: A-Z lower-cased, `words` words
        each; the whole sequence if it is shorter; none without words."""
        w = self.words((text or "").encode("utf-8", "surrogatepass").lower())
        if not len(w):
            return w
        k = min(words, len(w))
        total = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            total = (total ^ w[i : len(w) - k + 1 + i]) * np.uint64(0xA0761D6478BD642F)
            total ^= total >> np.uint64(29)
        return np.unique(mix(total))
