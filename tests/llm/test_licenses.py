import random
import re

import pytest

from opsloom.llm import license_scan as ls
from opsloom.llm.license_texts import NOTICES, PHRASES

DOCS = "doc_id long, text string, uid string, id string, template string, place string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(text):
    w = words(text)
    return [(i, label) for label, phrase in PHRASES for p in [phrase.split()]
            for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]


def texts():
    pick = random.Random(5)
    parts = ["Released under the MIT License.", "CC-BY-NC", "cc by", "nc", "Apache License, Version 2.0", "under the", "mit license",
             "version 2", "é", "ÄPFEL", "\x00", "漢字 cc by nc", "  ", "\n", "this work", "the software", "1.5", "CC BY NC CC BY NC"]
    made = [pick.choice([" ", "\n", "-"]).join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(200)]
    return [*made, None, "", "cc", "cc by", "cc by nc", "under the mit license " * 500]


def rows():
    made = [(i, t) for i, t in enumerate(texts())]
    return [(i, t, "u", "i", "t", "p") for i, t in [*made, made[0], made[3], (None, made[9][1])]]


def test_base_equals_brute_force(table):
    got = ls.license_scan(table(rows(), DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows())
    text = {i: t for i, t, *_ in rows()}
    for r in got:
        at = places(text[r.doc_id])
        start = [i for i, _ in at]
        assert (r.n_words, r.n_base) == (len(words(text[r.doc_id])), len(at)), r
        assert (r.first_word, r.last_word) == ((min(start), max(start)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not at)


def test_notices_whole_changed_and_apart(table):
    pick = random.Random(1)
    mit, isc = (next(t for x, t in NOTICES if x == name) for name in ("mit", "isc"))
    w = mit.split()
    for i in range(10, len(w), 17):          # a word put in, left out or replaced
        w[i] = pick.choice(["", "strange", f"{w[i]} extra"])
    changed = "intro words here " + " ".join(w)
    halves = " ".join(mit.split()[:60])
    mixed = " ".join(pick.sample(mit.split(), len(mit.split())))
    gpl = "This work is licensed under the GNU General Public License, version 3."
    docs = [(0, mit), (1, changed), (2, halves), (3, mixed), (4, mit + " " + isc), (5, gpl), (6, "the software is provided")]
    got = {r.doc_id: r for r in ls.license_scan(table([(*d, "", "", "", "") for d in docs], DOCS)).collect()}
    assert got[0].labels == "mit" and got[0].score == 1
    assert got[1].labels == "mit" and 0.8 <= got[1].score < 1
    assert got[2].labels == "" and 0.3 < got[2].score < 0.8
    assert got[3].labels == "" and got[6].labels == ""
    assert got[4].labels == "isc,mit" and got[5].labels == "gpl-3"
    assert all(r.n_base == 0 and r.first_word is None for r in got.values())


def test_grams_of_long_texts_in_stretches(table, monkeypatch):
    monkeypatch.setattr(ls, "_ROWS", 7)
    text = "x y z " * 11 + "under the mit license " + "a b " * 9
    w = ls.words_of_text(text)
    got = [(int(p), g) for _, place, _, gram in ls._grams(w, 3) for p, g in zip(place, gram.to_pylist())]
    flat = text.split()
    assert got == [(i, " ".join(flat[i:i + 3])) for i in range(len(flat) - 2)]


def test_own_templates_and_empty_tables(table):
    own = [("house", "our own house rules apply here")]
    got = ls.license_scan(table([(1, "Our own, house rules: apply here!", "", "", "", "")], DOCS), phrases=own, notices=[]).first()
    assert (got.n_base, got.first_word, got.labels) == (1, 0, "house")
    assert ls.license_scan(table([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        ls.license_scan(table([], DOCS), phrases=[("x", "two words")])
