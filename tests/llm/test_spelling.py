import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import spelling
from opsloom.llm.one_edit import acceptor, one_edit_pairs

DOCS = "doc_id long, text string, word string, n string, key string"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, length=7):
    words = Counter()
    for name, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= length:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= 2}
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x.append(root)
    return out


def prepared(words, size):
    words = sorted(w for w in words if len(w) == size)
    raw = "".join(words).encode("latin-1")
    begin = np.arange(len(words), dtype=np.int64) * size
    return words, np.frombuffer(raw, np.uint8), begin


def test_acceptor_is_minimal_and_counts_words():
    words, flat, begin = prepared(["abing", "cding", "efing", "abong"], 5)
    m = acceptor(flat, begin, np.full(4, 5), np.zeros(4, np.int64))
    assert [len(x.first) - 1 for x in m.levels] == [1, 1, 1, 2, 3, 1]     # "ng" stands once, "ing" once
    assert m.levels[5].words.tolist() == [4]


@pytest.mark.parametrize("seed", range(6))
def test_pairs_equal_brute_force(seed):
    pick = random.Random(seed)
    letters = "ab\xe9" if seed % 2 else "abcdefgh"
    short = sorted({"".join(pick.choice(letters) for _ in range(5)) for _ in range(120)})
    long = sorted({"".join(pick.choice(letters) for _ in range(6)) for _ in range(120)})
    words = short + long
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size) - size
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    group = (size == 6).astype(np.int64)
    i, j = one_edit_pairs(flat, begin, size, group, np.array([0]), np.array([1]), np.array([True]))
    got = [(words[a], words[b]) for a, b in zip(i, j)]
    assert len(got) == len(set(got))
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in short for b in words if one_apart(a, b)}
    i, j = one_edit_pairs(flat, begin, size, group, np.array([0]), np.array([1]), np.array([False]))
    got = {(words[a], words[b]) for a, b in zip(i, j)}
    assert not any(len(b) == 6 and b.startswith(a) for a, b in got)       # a symbol more at the very end belongs elsewhere


def corpus():
    pick = random.Random(8)
    stems = ["".join(pick.choice("abcde\xe9\xffx") for _ in range(pick.randint(6, 11))) for _ in range(40)]
    stems += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "Zebraaa\xd7", "naturel\xf7e"]
    rows = []
    for i in range(150):
        some = []
        for _ in range(pick.randint(0, 60)):
            w = stems[min(int(pick.expovariate(0.12)), len(stems) - 1)]
            if pick.random() < 0.15:
                k = pick.randrange(len(w))
                w = pick.choice([w[:k] + w[k + 1:], w[:k] + pick.choice("abcx") + w[k:], w[:k] + pick.choice("abcx") + w[k + 1:]])
            some.append(w.upper() if pick.random() < 0.1 and w.isascii() else w)
        rows.append((i, pick.choice([" ", ", ", "ā", "1"]).join(some)))
    rows += [rows[3], rows[3], (None, "abcdefgh abcdefgh abcdefgh"), (500, None), (501, ""), (502, "Kİstanbul")]
    return rows


@pytest.mark.parametrize("crowd", [30_000, 3])
def test_variants_equal_brute_force(table, crowd):
    rows = corpus()
    df = table([(i, t, "x", "y", "z") for i, t in rows], DOCS)
    got = spelling.spelling_variants(df, crowd=crowd).collect()
    want = brute(rows)
    assert len(got) == len(want) > 100
    for r in got:
        assert [r.form, r.n, r.n_near, r.form_n, r.root] == want[r.word], r
    assert any(x[0] for x in want.values())


def test_chains_are_followed(table):
    base = "abcdefgh"
    words = [base[:7] + "h"] * 1000 + [base[:6] + "xh"] * 100 + [base[:5] + "yxh"] * 10
    texts = [(i, w) for i, w in enumerate(words)]
    got = {r.word: r for r in spelling.spelling_variants(table([(i, t, "", "", "") for i, t in texts], DOCS), error=10**12, count=1).collect()}
    assert got["abcdeyxh"].form == "abcdefxh" and got["abcdeyxh"].root == base
    assert got[base].form is None and got[base].root == base


def test_tables_without_words(table):
    assert spelling.spelling_variants(table([(1, None, "", "", ""), (2, "short", "", "", "")], DOCS)).count() == 0
    assert spelling.spelling_variants(table([], DOCS)).count() == 0


def test_very_long_runs(table):
    long = "ab" * 3000
    got = {r.word: r for r in spelling.spelling_variants(
        table([(1, long, "", "", ""), (1, long + " " + long[:-1] + "c", "", "", ""), (2, long[:-1] + "c", "", "", "")], DOCS), error=10**12).collect()}
    assert got[long].n_near == 1 and len(got) == 2


def test_code_points_of_strings():
    flat, place = spelling._symbols(pa.array(["x", "a\xe9b", "", "\xff\xd7"]).slice(1))
    assert flat.tolist() == [97, 0xE9, 98, 0xFF, 0xD7] and place.tolist() == [0, 3, 3, 5]
