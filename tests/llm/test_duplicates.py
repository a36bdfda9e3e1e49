import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import WORDS, prose

from opsloom.llm import decontaminate, fuzzy_lines, near_duplicates
from opsloom.llm.arrow import text_pieces
from opsloom.llm.banding import _smallest_so_far
from opsloom.llm.components import components, extended
from opsloom.llm.words import words_of

DOCS = "doc_id long, text string, uid long, lines string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def changed(text, seed, n):
    words, pick = text.split(" "), random.Random(seed)
    for _ in range(n):
        words[pick.randrange(len(words))] = pick.choice(WORDS)
    return " ".join(words)


def texts():
    base = [prose(s, 120) for s in range(12)]
    out = base + [changed(b, i, n) for i, (b, n) in enumerate(zip(base * 3, [1, 2, 3, 4, 6, 9] * 6))]
    hot = prose(99, 200)
    out += [hot] * 30 + [changed(hot, i, 2) for i in range(40)] + [hot.upper() + "!"]
    return out + [None, None, "", "", "!!", "!!", "?", "one two", "One, two", "one two three", prose(5, 6000)]


def rows(values):
    return [(i, t, i % 3, "x", 1) for i, t in enumerate(values)]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def j_p(x, y):
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in keys) for d in x.keys() & y.keys())


def brute_classes(values):
    sets = []
    for t in values:
        w = split(t)
        n = min(5, len(w))
        sets.append(Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else Counter())
    parent = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            same = values[i] is not None and values[i] == values[j] and not sets[i]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) * 3 > len(sets[i]) and j_p(sets[i], sets[j]) >= 0.8:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(len(values))]


def test_near_duplicates_equal_brute_force(table):
    values = texts()
    docs = table(rows(values), DOCS)
    got = {r.doc_id: r for r in near_duplicates.class_report(docs).collect()}
    want = brute_classes(values)
    assert [got[i].class_id for i in range(len(values))] == want
    assert all(got[i].class_size == want.count(want[i]) and got[i].kept == (want[i] == i) for i in got)
    one = near_duplicates.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(want))


def test_signatures_estimate_probability_jaccard():
    a = prose(1, 300)
    pair = [a + " " + a[:300], changed(a, 2, 15)]
    raw = np.frombuffer("".join(pair).encode(), np.uint8)
    sets = near_duplicates.weighted_shingles(words_of(raw, np.array([0, len(pair[0]), len(raw)])), 5)
    signature = near_duplicates.prob_minhash(*sets, 2, 1024)
    parts = [(sets[1][sets[0] == i], sets[2][sets[0] == i]) for i in (0, 1)]
    exact = near_duplicates.probability_jaccard(*parts)
    brute = j_p(*(Counter(dict(zip(k.tolist(), w.tolist()))) for k, w in parts))
    assert abs(exact - brute) < 1e-9
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 100 + i) for i in range(50)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[500] == got[149] == 100 and got[901] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_come_later(spark):
    first = components(spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    got = {r.node: r.root for r in extended(first, spark.createDataFrame([(9, 2), (20, 6), (30, 31)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 8: 1, 9: 1, 5: 5, 6: 5, 20: 5, 30: 30, 31: 30}


def lines_fixture():
    line = "Copyright notice of the site, all rights are reserved by the owner number 12345"
    return [
        f"first words of it\n{line}\n\nanother own line here", f"{line.replace('12345', '12346')}\nsecond words of it all",
        line, f"{line}\n{line}", None, "", "***\n***", "***", "Short", "short!", "own\nown", prose(3, 4000) + "\nShort",
        "first words of it\nsomething new that stands alone here", *[f"own line {prose(i, 30)}\n{line}" for i in range(20)],
    ]


def brute_lines(values, least=0.8):
    forms, first, out = [], {}, []
    sets = {}
    for t in values:
        for line in (t or "").split("\n"):
            f = " ".join(split(line))
            if f and f not in sets:
                sets[f] = {f[k:k + 8] for k in range(max(1, len(f) - 7))}
                forms.append(f)
    parent = {f: f for f in forms}
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                parent[find(parent, a)] = find(parent, b)
    for t in values:
        if t is None:
            out.append(None)
            continue
        stay = []
        for line in t.split("\n"):
            f = " ".join(split(line))
            root = find(parent, f) if f else None
            if root is None or root not in first:
                stay.append(line)
                first[root] = 1
        out.append("\n".join(stay))
    return out


def test_fuzzy_lines_equal_brute_force(table):
    values = lines_fixture()
    docs = table(rows(values), DOCS)
    out = fuzzy_lines.without_repeats(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    want = brute_lines(values)
    assert [got[i].text for i in range(len(values))] == want
    for i, t in enumerate(values):
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[i].n_removed <= got[i].n_lines
    kept = fuzzy_lines.cleaned_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 2 not in ids and 3 not in ids and {4, 5, 6, 7} <= ids


def crowd(n, shared, own, changes):
    """Texts on one template, less alike than 0.8 to each other, and a near copy of every tenth far behind it."""
    template = prose(77, shared)
    out = [f"{template} {prose(1000 + i, own)}" for i in range(n)]
    copies = []
    for i in range(0, n, 10):
        words = out[i].split(" ")
        for k in range(changes):
            words[-1 - 6 * k] = f"new{i}x{k}"
        copies.append(" ".join(words))
    return out + copies[::-1]


def shares(values, shingles):
    sets = [shingles(v) for v in values]
    j = lambda a, b: len(a & b) / len(a | b)
    n = len(values) * 10 // 11
    apart = max(j(sets[i], sets[k]) for i in range(0, n, 7) for k in range(i))
    close = min(j(sets[10 * i], sets[-1 - i]) for i in range(n // 10))
    return apart, close


def test_near_copies_within_a_crowd_of_lines(table):
    values = crowd(600, 60, 14, 2)
    apart, close = shares(values, lambda v: {v[k:k + 8] for k in range(len(v) - 7)})
    assert 0.7 < apart < 0.8 < close
    got = fuzzy_lines.without_repeats(table(rows(values), DOCS))
    assert sum(r.n_removed for r in got.collect()) == 60


def test_near_copies_within_a_crowd_of_documents(table):
    values = crowd(600, 120, 20, 3)
    apart, close = shares(values, lambda v: {tuple(v.split(" ")[k:k + 5]) for k in range(len(v.split(" ")) - 4)})
    assert 0.7 < apart < 0.8 < close
    got = near_duplicates.class_report(table(rows(values), DOCS))
    assert sum(not r.kept for r in got.collect()) == 60


def items():
    return [("a", prose(50, 30)), ("b", prose(50, 30)), ("c", "kurz und gut"), ("d", None), ("e", ""), (None, prose(51, 12)),
            ("a", prose(52, 14)), ("f", "the the the the the the the the the the the the")]


def brute_hits(text):
    w = split(text)
    hit, found = set(), set()
    for name, t in items():
        v = split(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == v[k:k + n]:
                    hit |= set(range(at, at + n))
                    if name is not None:
                        found.add(name)
    return len(w), len(hit), sorted(found)


def decontamination_texts():
    a = prose(50, 30).split(" ")
    return [None, "", "-- !", "KURZ, und gut", "kurz und", " ".join(a), " ".join(a[:9]), " ".join(a[3:13]).upper(),
            prose(1, 500) + " " + " ".join(a[5:25]) + " " + prose(2, 300), prose(51, 12), "the " * 500,
            prose(52, 14) + " kurz und gut", prose(3, 9000) + " kurz und gut " + " ".join(a), "é" * 40, " ".join(a)]


def test_decontamination_equals_brute_force(spark, table):
    values = decontamination_texts()
    docs = table(rows(values), DOCS)
    bench = table([(i, t, 0) for i, t in items()], "item_id string, text string, doc_id int")
    for block in (decontaminate.BLOCK_BYTES, 300):
        found = {r.doc_id: r for r in decontaminate.find_overlaps(docs, bench, block_bytes=block).collect()}
        for i, t in enumerate(values):
            runs = found[i]["hit_runs"]
            hit = sum(b - a for a, b in zip(runs[::2], runs[1::2]))
            assert (found[i]["_n_words"], hit, found[i]["hit_items"]) == brute_hits(t), i
    report = {r.doc_id: r for r in decontaminate.overlap_report(docs, bench).collect()}
    assert all((r.n_words, r.n_hit, r.n_items) == (*brute_hits(values[i])[:2], len(brute_hits(values[i])[2]))
               for i, r in report.items())
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(values) if not brute_hits(t)[1]]


def test_empty_tables(table):
    docs = table([], DOCS)
    some = table(rows(["one line", None]), DOCS)
    bench = table([], "item_id string, text string")
    assert decontaminate.overlap_report(docs, bench).count() == 0
    assert decontaminate.overlap_report(some, bench).filter("contaminated").count() == 0
    assert near_duplicates.class_report(docs).count() == 0
    assert fuzzy_lines.without_repeats(docs).count() == 0


def test_lines_are_read_and_taken_out_like_splits():
    pick = random.Random(2)
    values = ["".join(pick.choice("aB1é漢 \n\n!-") for _ in range(pick.randint(0, 40))) for _ in range(300)] + ["", "\n", "x\n", None]
    for _, _, raw, offsets in text_pieces(pa.array(values), 10**6):
        lines = fuzzy_lines.Lines(raw, offsets)
        spoken = [(i, k, " ".join(split(x)), x) for i, t in enumerate(values) for k, x in enumerate((t or "").split("\n")) if split(x)]
        code = lines.code
        forms = ["".join(map(chr, code[a:b])) for a, b in zip(lines.start, lines.end)]
        assert [(i, k, f) for i, k, f, _ in spoken] == list(zip(lines.text, lines.number, forms))
        assert [x for *_, x in spoken] == [(values[i] or "").encode()[b:b + n].decode() for i, b, n in zip(lines.text, lines.begin, lines.size)]
        gone = [sorted(pick.sample(range(n), pick.randint(0, n))) if (n := (t or "").count("\n") + 1) % 3 else None for t in values]
        edge, data, there, taken = fuzzy_lines._without(raw, offsets, pa.array(gone, pa.list_(pa.int32())))
        got = pa.StringArray.from_buffers(len(values), edge, data).to_pylist()
        for t, g, out, n, k in zip(values, gone, got, there, taken):
            parts = (t or "").split("\n")
            assert out == "\n".join(x for i, x in enumerate(parts) if i not in (g or [])) and n == len(parts) and k == len(g or [])


def test_smallest_of_runs():
    assert _smallest_so_far(np.array([5, 3, 9, 8, 2, 7]), np.array([0, 0, 0, 2, 2, 3])).tolist() == [5, 3, 3, 8, 2, 7]
    assert len(_smallest_so_far(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_windows_and_pairs():
    code = np.arange(50, dtype=np.uint32) % 7
    for width in (1, 3, 5, 8):
        keys = fuzzy_lines._windows(code, width)
        assert len(keys) == 51 - width and len(set(keys.tolist())) == 7
    a, b = "abcdefghijklmnopqrst", "abcdefghijklmnopqrsx"
    good = fuzzy_lines._pairs_alike(pa.array([a, a, a, "xy"]), pa.array([a, b, "other words here", "xy"]), 8, 0.8)
    assert good.tolist() == [True, True, False, True]
