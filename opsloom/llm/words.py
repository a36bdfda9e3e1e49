"""Words of whole texts as hashes: lower-cased A-Z, runs of letters, digits and
non-ASCII characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from opsloom.llm.arrow import SpanHasher, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_HASH = SpanHasher(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of consecutive texts; ``first[i]:first[i + 1]`` are those of text i."""

    raw: np.ndarray      # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray      # 64-bit hash of each word
    first: np.ndarray

    def spell(self, low: int, high: int) -> bytes:
        """Words low..high, joined by one space."""
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.start[low:high], self.end[low:high]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts raw[offsets[i]:offsets[i + 1]]."""
    raw = LOWER[raw]
    inside = WORD[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(raw, start, end, _HASH(raw, start, end), np.searchsorted(start, offsets))


def words_of_text(text: str | None) -> Words:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))


def runs_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive keys, by the run's first place."""
    n = max(len(keys) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = mix(out + keys[j:j + n] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
    return out


def shingles_of(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word shingle; a shorter text, if it has a word, is one shingle."""
    counts = w.counts
    runs = runs_of(w.key, width)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[:len(runs)] == owner[width - 1:width - 1 + len(runs)]
    texts, keys = owner[:len(runs)][inside], runs[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            low, high = w.first[t], w.first[t + 1]
            extra[i] = runs_of(w.key[low:high], int(high - low))[0]
        texts, keys = np.concatenate([texts, short]), np.concatenate([keys, extra])
    return texts, keys
