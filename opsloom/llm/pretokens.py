"""Pre-tokens of byte-level BPE vocabularies, found for many texts at once, and
ids by the tokenizers library, which sees each distinct pre-token once."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from opsloom.llm.arrow import SpanHasher, spans

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Unicode white space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that are pre-tokens of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens whose ids a Python worker remembers.
REMEMBERED = 350_000

_FIRST, _SECOND = SpanHasher(0x9E3779B97F4A7C15), SpanHasher(0xD1B54A32D192ED03)


@lru_cache(1)
def _kinds() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = LETTER
        elif major == "N":
            table[code] = NUMBER
    table[WHITE] = SPACE
    return table


@lru_cache(1)
def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass
class PreTokens:
    """Pre-tokens of consecutive texts, in order."""

    text: str            # all texts, joined
    start: np.ndarray    # in characters
    end: np.ndarray
    owner: np.ndarray    # number of the text
    first: np.ndarray    # two hashes
    second: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of one of each distinct pre-token, number of the distinct one for each)."""
        _, place, number = np.unique(self.first, return_index=True, return_inverse=True)
        if (self.second != self.second[place][number]).any():
            pairs = np.stack([self.first, self.second], 1)
            _, place, number = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        return place, number.reshape(-1)

    def spell(self, places: np.ndarray) -> list[str]:
        text = self.text
        return [text[s:e] for s, e in zip(self.start[places].tolist(), self.end[places].tolist())]


def pre_tokens(raw: np.ndarray, offsets: np.ndarray, added: Iterable[str]) -> PreTokens:
    """Split the texts raw[offsets[i]:offsets[i + 1]] (UTF-8).

    Runs of letters, of numbers and of other signs are pre-tokens, with one
    blank before them if there is one; white space before such a run is one,
    but for its last character; the ENDINGS after an apostrophe stand alone.
    """
    text = raw.tobytes().decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    bounds = chars[offsets]
    n = len(code)
    kind = _kinds()[code]
    cut = np.zeros(n + 1, bool)      # a part of a text begins here
    cut[bounds] = True
    cut[n] = True
    marks: list[tuple[int, int]] = []
    for word in added:
        at = text.find(word)
        while at >= 0:
            if not cut[at + 1:at + len(word)].any():
                marks.append((at, at + len(word)))
            at = text.find(word, at + len(word))
    marks.sort()
    for low, high in marks:
        cut[low] = cut[high] = True
        kind[low:high] = OTHER
    begins = cut[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = begins.copy()
    # White space before something else in the same part gives up its last character.
    last = np.flatnonzero((kind == SPACE) & np.append(begins[1:], True) & ~cut[1:])
    begins[last] = True
    begins[last[code[last] == 32] + 1] = False
    # An apostrophe that begins a pre-token of its own.
    for at in np.flatnonzero((code == 39) & begins & run).tolist():
        for ending in ENDINGS:
            stop = at + 1 + len(ending)
            if text.startswith(ending, at + 1) and not cut[at + 1:stop].any():
                begins[at + 1:stop] = False
                if stop < n and not cut[stop]:
                    if kind[stop] == LETTER:
                        begins[stop] = True
                break
    start = np.flatnonzero(begins)
    if marks:
        inside = np.zeros(n + 1, np.int64)
        for low, high in marks:
            inside[low + 1] += 1
            inside[high] -= 1
        start = start[np.cumsum(inside)[start] == 0]
    end = np.append(start[1:], n)
    owner = np.searchsorted(bounds, start, "right") - 1
    return PreTokens(text, start, end, owner, _FIRST(code, start, end), _SECOND(code, start, end))


class Encoder:
    """Ids of whole texts; the library encodes each distinct pre-token once per worker.

    Suits vocabularies whose pre-tokens are split as in ``pre_tokens`` and
    encoded one by one (byte-level BPE without normaliser).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        step = made.get("pre_tokenizer") or {}
        if step.get("type") != "ByteLevel" or step.get("add_prefix_space") or made.get("normalizer"):
            raise ValueError("needs a byte-level BPE vocabulary without normaliser and prefix space")
        self.added = {x["content"]: x["id"] for x in made.get("added_tokens", [])}
        self.size = self.library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        # By first hash, ascending: the hash and the number of its pre-token; by number: second hash, place of the ids.
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.check, self.place = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode_each(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token, by the library's model on its byte-level spelling."""
        tokenize, signs, added = self.library.model.tokenize, _byte_signs(), self.added
        return [[added[piece]] if piece in added else
                [x.id for x in tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(signs))]
                for piece in pieces]

    def _learn(self, t: PreTokens, places: np.ndarray) -> np.ndarray:
        """Remember the ids of distinct pre-tokens; their numbers."""
        ids = self.encode_each(t.spell(places))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(flat), self.used), np.uint32)])
        self.flat[self.used:self.used + len(flat)] = flat
        numbers = np.arange(len(self.check), len(self.check) + len(ids))
        self.check = np.concatenate([self.check, t.second[places]])
        self.place = np.concatenate([self.place, self.used + np.cumsum(lengths)])
        self.used += len(flat)
        return numbers

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        n = len(offsets) - 1
        t = pre_tokens(raw, offsets, self.added)
        if not len(t.start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        place, number = t.distinct()
        if len(self.check) + len(place) > REMEMBERED:
            self._forget()
        first = t.first[place]
        at = np.searchsorted(self.hash, first)
        known = np.zeros(len(first), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == first[inside]
        found = np.zeros(len(first), np.int64)
        found[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found[new] = self._learn(t, place[new])
            order = new[np.argsort(first[new], kind="stable")]
            self.hash = np.insert(self.hash, at[order], first[order])
            self.number = np.insert(self.number, at[order], found[order].astype(np.int32))
        clash = np.flatnonzero(self.check[found] != t.second[place])
        if len(clash):      # two pre-tokens with one first hash: encoded anew each time
            found[clash] = self._learn(t, place[clash])
        each = (self.place[found + 1] - self.place[found])[number]
        flat = self.flat[spans(self.place[found][number], each)]
        counts = np.bincount(t.owner, weights=each, minlength=n).astype(np.int64)
        return flat, counts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)
