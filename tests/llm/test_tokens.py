import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from opsloom.llm import packing, piece_counts, token_file
from opsloom.llm.arrow import text_pieces
from opsloom.llm.pretokens import Encoder
from opsloom.llm.queries import vocabulary
from opsloom.session import new_scratch

DOCS = "doc_id long, text string, uid long, n long"
SIGNS = ["a", "B", "é", "ß", "1", "²", " ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ll", "!", "...",
         "<|endoftext|>", "<|endo", "漢字", "🙂", "‍", "-", "\r\n", "'ve ", " 'd", "''t", "́", "\x00"]


@pytest.fixture(scope="module")
def coder():
    return Encoder(vocabulary())


def odd_texts():
    pick = random.Random(3)
    texts = ["".join(pick.choice(SIGNS) for _ in range(pick.randint(0, 25))) for _ in range(400)]
    return texts + ["", None, prose(1, 20_000), prose(2, 5)]


def rows():
    return [(i, t, 0, 0) for i, t in enumerate(odd_texts())] + [(7, "repeated", 1, 1), (7, "repeated", 1, 1), (None, "no id", 0, 0)]


def ids(coder, text, end):
    return coder.library.encode(text or "", add_special_tokens=False).ids + end


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_ids_equal_the_library(coder):
    texts, got = odd_texts(), []
    for _, _, raw, offsets in text_pieces(pa.array(texts), 3000):
        flat, counts = coder.ids(raw, offsets)
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [ids(coder, t, []) for t in texts]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    raw = token_file.pack_bits(x, bits)
    assert len(raw) == -(-1003 * bits // 8)
    assert (token_file.unpack_bits(raw, bits, 1003) == x).all()


def test_file_has_random_access(tmp_path):
    x = np.random.default_rng(1).integers(0, 50_257, 20_000).astype(np.uint32)
    writer = token_file.TokenWriter(open(tmp_path / "a.tok", "wb"), 17)
    writer.add(x[:9000], np.array([9000]), np.array([1]))
    writer.add(x[9000:], np.array([0, 11_000]), np.array([2, 3]))
    writer.close()
    reader = token_file.TokenReader(str(tmp_path / "a.tok"))
    assert reader.documents == 3 and reader.lengths.tolist() == [9000, 0, 11_000]
    for low, high in ((0, 1), (4095, 4097), (8000, 17_001), (19_999, 20_000), (5, 5)):
        assert (reader.read(low, high) == x[low:high]).all()


def test_token_files(spark, table, coder):
    docs = table(rows(), DOCS)
    got = token_file.round_trip(docs, vocabulary()).orderBy("start").collect()
    want, start = [], 0
    for key, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((key, len(ids(coder, text, [2])), crc(ids(coder, text, [2]))))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (k if k is not None else -1, n, c) for k, n, c in want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    manifest = token_file.write_tokens(docs, vocabulary(), new_scratch(spark, "t"))
    one = token_file.read_tokens(manifest).filter("doc_id = 3").collect()
    assert one[0].ids == ids(coder, rows()[3][1], [2])


def test_packing(table, coder):
    out = packing.pack_documents(table(rows(), DOCS), vocabulary()).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for key, text, *_ in rows():
        whole = ids(coder, text, [0])
        pieces = [r for r in by_doc[key] if key != 7 or r.length == len(whole) and r.ids_crc32 == crc(whole)]
        if key == 7:
            assert pieces
            continue
        pieces.sort(key=lambda r: r.piece)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(whole)
        assert all(p.length == 2048 for p in pieces[1:]) and pieces[0].length <= 2048
        assert all(p.ids_crc32 == crc(whole[p.start:p.start + p.length]) for p in pieces)
    assert len(by_doc[7]) == 3
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist()
        assert sum(n for _, n in held) <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1


def test_open_bins_are_bounded_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (7, 6, 5)] == [0, 1, 2]     # sequence 0 was fullest and closed
    assert bins.place(4) == (1, 6) and bins.place(5) == (2, 5)
    assert bins.open == 0


def test_token_counts(table, coder):
    got = piece_counts.token_counts(table(rows(), DOCS), vocabulary(), limit=10).collect()
    want = sorted((k if k is not None else -1, len((t or "").encode()), len(ids(coder, t, []))) for k, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_empty_table(table):
    docs = table([], DOCS)
    assert token_file.round_trip(docs, vocabulary()).count() == 0
    assert packing.pack_documents(docs, vocabulary()).count() == 0
    assert piece_counts.token_counts(docs, vocabulary()).count() == 0
