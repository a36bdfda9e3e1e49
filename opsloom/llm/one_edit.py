"""Pairs of words one edit apart, by composing finite-state machines.

The words of many groups are one minimised acceptor in which every group has an
initial state of its own. It is composed with a transducer that makes exactly
one edit, and with itself: first along equal symbols, then over the edit, then
along equal symbols to the end. Composed states from which no end is reached
are trimmed before accepted pairs are enumerated. Everything works on whole
levels of the machines as numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from opsloom.llm.arrow import distinct, mix, spans

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_NONE = np.zeros(0, np.int64)


@dataclass
class _Level:
    """The states from which all words end after the same number of symbols."""

    first: np.ndarray     # arcs of state s: first[s]:first[s + 1], by symbol
    symbol: np.ndarray
    to: np.ndarray        # state one level below
    skip: np.ndarray      # words of the source state before those of the arc
    words: np.ndarray     # words accepted from each state

    def arcs_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the place in ``states``, arc) of every arc that leaves them."""
        count = self.first[states + 1] - self.first[states]
        return np.repeat(np.arange(len(states)), count), spans(self.first[states], count)

    def find(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The arc of each state with the symbol, or -1."""
        if not len(self.symbol):
            return np.full(len(states), -1)
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 8 | self.symbol
        want = states << 8 | symbols
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at, -1)

    def both(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, arc of left, arc of right) for every symbol that both states accept."""
        place, arc = self.arcs_of(left)
        other = self.find(right[place], self.symbol[arc])
        on = other >= 0
        return place[on], arc[on], other[on]


@dataclass
class Acceptor:
    """The minimised acceptor of sorted words; ``start[i]`` is the initial state of group i."""

    levels: list[_Level]
    start: np.ndarray


def acceptor(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> Acceptor:
    """Words flat[begin[i]:begin[i] + size[i]]; those of one group stand together,
    sorted, without repeats and of one length. Symbols are below 256."""
    n = len(begin)
    opens = np.ones(n, bool)
    opens[1:] = group[1:] != group[:-1]
    shared = np.where(opens, -1, 0)      # symbols shared with the word before
    alive = np.flatnonzero(~opens)
    depth = 0
    while len(alive):
        alive = alive[size[alive] > depth]
        alive = alive[flat[begin[alive] + depth] == flat[begin[alive - 1] + depth]]
        depth += 1
        shared[alive] = depth
    levels = [_Level(np.zeros(2, np.int64), _NONE, _NONE, _NONE, np.ones(1, np.int64))]
    state = np.zeros(n, np.int64)        # of the node that begins at a word, on the level below
    start = np.zeros(int(opens.sum()), np.int64)
    number = np.cumsum(opens) - 1
    rows = np.arange(n)
    for height in range(1, int(size.max(initial=0)) + 1):
        rows = rows[size[rows] >= height]
        rows = rows[shared[rows] < size[rows] - height + 1]       # first words of nodes one level below
        parent = shared[rows] < size[rows] - height
        at = np.flatnonzero(parent)
        symbol = flat[begin[rows] + size[rows] - height].astype(np.int64)
        to = state[rows]
        below = levels[-1].words[to]
        with np.errstate(over="ignore"):
            code = (to << 8 | symbol).astype(np.uint64)
            one = np.add.reduceat(mix(code * _ONE + _TWO), at)
            two = np.add.reduceat(mix(code * _TWO + _ONE), at)
        _, place, same = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[place][same]).any():
            _, place, same = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        ends = np.append(at[1:], len(rows))
        count = (ends - at)[place]
        arcs = spans(at[place], count)
        before = np.cumsum(below) - below
        total = np.add.reduceat(below, at)[place]
        first = np.zeros(len(place) + 1, np.int64)
        np.cumsum(count, out=first[1:])
        skip = before[arcs] - np.repeat(before[at[place]], count)
        levels.append(_Level(first, symbol[arcs], to[arcs], skip, total))
        nodes = rows[at]
        state[nodes] = same
        done = nodes[size[nodes] == height]
        start[number[done]] = state[done]
    return Acceptor(levels, start)


@dataclass
class _Open:
    """Composed paths after the edit, on one level: two states and the words before theirs."""

    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _joined(parts: list[_Open]) -> _Open:
    return _Open(*(np.concatenate([getattr(p, k) for p in parts]) if parts else _NONE
                   for k in ("left", "right", "low", "high")))


def _arc_pairs(level: _Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pair of each state, arc, later arc): all pairs of arcs that leave one state."""
    degree = np.diff(level.first)
    end = np.repeat(level.first[1:], degree)
    arc = np.arange(len(level.symbol))
    after = end - arc - 1
    first = np.zeros(len(degree) + 1, np.int64)
    np.cumsum(degree * (degree - 1) // 2, out=first[1:])
    return first, np.repeat(arc, after), spans(arc + 1, after)


def one_edit_pairs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray,
                   shorter: np.ndarray, longer: np.ndarray, at_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs of words one edit apart, each once.

    Words are as for ``acceptor``. ``shorter[k]`` and ``longer[k]`` number two
    groups, -1 if there is none: pairs are looked for within the first (one
    symbol replaced) and from the first to the second, whose words have one
    symbol more. ``at_end[k]`` says whether that symbol may be the last.
    """
    if not len(begin):
        return _NONE, _NONE
    machine = acceptor(flat, begin, size, group)
    opens = np.ones(len(group), bool)
    opens[1:] = group[1:] != group[:-1]
    base = np.flatnonzero(opens)
    levels = machine.levels
    tall = size[base[shorter]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    edited: dict[int, list[_Open]] = {}
    same = (_NONE,) * 5        # short state, long state or -1, words before each, set of groups
    for height in range(int(tall.max()), -1, -1):
        new = np.flatnonzero(tall == height)
        has = longer[new] >= 0
        begun = (machine.start[shorter[new]], np.where(has, machine.start[longer[new]], -1),
                 base[shorter[new]], np.where(has, base[longer[new]], 0), new)
        s, t, low, high, k = (np.concatenate(x) for x in zip(same, begun))
        level = levels[height]
        # One symbol more in the longer word; what follows differs from it, so that the place is unique.
        on = np.flatnonzero(t >= 0)
        if height == 0:
            on = on[at_end[k[on]]]
        if len(on):
            place, arc = levels[height + 1].arcs_of(t[on])
            put, to = levels[height + 1].symbol[arc], levels[height + 1].to[arc]
            place = on[place]
            ahead = high[place] + levels[height + 1].skip[arc]
            if height == 0:
                found.append((low[place], ahead))
            else:
                p, x, y = level.both(s[place], to)
                other = level.symbol[x] != put[p]
                p, x, y = p[other], x[other], y[other]
                edited.setdefault(height - 1, []).append(_Open(
                    level.to[x], level.to[y], low[place[p]] + level.skip[x], ahead[p] + level.skip[y]))
        if height == 0:
            break
        # One symbol replaced.
        first, x, y = _arc_pairs(level)
        count = first[s + 1] - first[s]
        place, pair = np.repeat(np.arange(len(s)), count), spans(first[s], count)
        x, y = x[pair], y[pair]
        edited.setdefault(height - 1, []).append(_Open(
            level.to[x], level.to[y], low[place] + level.skip[x], low[place] + level.skip[y]))
        # One equal symbol.
        place, arc = level.arcs_of(s)
        follow = np.full(len(place), -1)
        ahead = high[place]
        on = np.flatnonzero(t[place] >= 0)
        if len(on):
            up = levels[height + 1]
            other = up.find(t[place[on]], level.symbol[arc[on]])
            on, other = on[other >= 0], other[other >= 0]
            follow[on] = up.to[other]
            ahead[on] += up.skip[other]
        same = (level.to[arc], follow, low[place] + level.skip[arc], ahead, k[place])
    found += _to_the_end(levels, edited)
    if not found:
        return _NONE, _NONE
    return tuple(np.concatenate(x) for x in zip(*found))


def _to_the_end(levels: list[_Level], edited: dict[int, list[_Open]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Follow equal symbols from the edit on: compose, trim, enumerate."""
    if not edited:
        return []
    top = max(edited)
    paths = {h: _joined(edited.get(h, [])) for h in range(top + 1)}
    wide = [len(x.first) for x in levels]
    states: dict[int, np.ndarray] = {}
    steps: dict[int, tuple] = {}
    coming = _NONE
    for h in range(top, 0, -1):
        code = distinct(np.concatenate([paths[h].left * wide[h] + paths[h].right, coming]))
        states[h] = code
        place, x, y = levels[h].both(code // wide[h], code % wide[h])
        below = levels[h].to[x] * wide[h - 1] + levels[h].to[y]
        steps[h] = (place, below, levels[h].skip[x], levels[h].skip[y])
        coming = distinct(below)
    alive = np.zeros(1, np.int64)       # composed states that reach the end; on level 0 there is one
    for h in range(1, top + 1):
        place, below, one, two = steps[h]
        at = np.minimum(np.searchsorted(alive, below), max(len(alive) - 1, 0))
        on = alive[at] == below if len(alive) else np.zeros(len(below), bool)
        place, below, one, two = place[on], below[on], one[on], two[on]
        first = np.searchsorted(place, np.arange(len(states[h]) + 1))
        steps[h] = (first, below, one, two)
        alive = states[h][np.diff(first) > 0]
    left = _Open(_NONE, _NONE, _NONE, _NONE)
    for h in range(top, 0, -1):
        left = _joined([left, paths[h]])
        first, below, one, two = steps[h]
        at = np.searchsorted(states[h], left.left * wide[h] + left.right)
        count = first[at + 1] - first[at]
        place, arc = np.repeat(np.arange(len(at)), count), spans(first[at], count)
        left = _Open(below[arc] // wide[h - 1], below[arc] % wide[h - 1],
                     left.low[place] + one[arc], left.high[place] + two[arc])
    left = _joined([left, paths[0]])
    return [(left.low, left.high)]
