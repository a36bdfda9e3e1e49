"""Token counts without ids: pieces are counted once per distinct pre-token,
joined to how often each document has it, and added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import spans, text_pieces
from opsloom.llm.pretokens import encoder, pre_tokens
from opsloom.llm.store import numbered, quoted

#: Text that one block of documents holds, in bytes.
BLOCK_BYTES = 7_000_000
#: A pre-token that more documents of a block have is dealt to this many tasks.
FREQUENT, SALTS = 64, 64


def _blocks(column: pa.Array, coder, limit: int):
    """(row, spelling, row numbers, counts) of pre-tokens, for row ranges of bounded size."""
    for low, high, raw, offsets in text_pieces(column, limit):
        t = pre_tokens(raw, offsets, coder.added)
        if len(t.start):
            place, number = t.distinct()
            # In alphabetical order, in which neighbours share most of their letters.
            words = t.spell(place)
            order = np.array(sorted(range(len(words)), key=words.__getitem__))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield low, t, place[order], rank[number]


def _frequencies(tokenizer: str):
    """Per block and pre-token: which documents have it, how often (packed).

    What many documents of a block have is salted by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for low, t, place, number in _blocks(batch.column(1), coder, BLOCK_BYTES):
                first = int(uids[low])
                width = int(t.owner.max()) + 1
                pair, times = np.unique(number * width + t.owner, return_counts=True)
                group, row = pair // width, pair % width
                packed = np.zeros(len(pair), [("row", "<u4"), ("times", "<u4")])
                packed["row"], packed["times"] = row, times
                narrow = row.max() < 1 << 16 and times.max() < 1 << 8
                if narrow:
                    packed = packed.astype([("row", "<u2"), ("times", "u1")])
                size = packed.dtype.itemsize
                ends = np.searchsorted(group, np.arange(len(place)), "right")
                offsets = np.concatenate([[0], ends]).astype(np.int32) * size
                salt = np.where(np.diff(offsets) > FREQUENT * size, np.int16(first // 1009 % SALTS), np.int16(0))
                packed_column = pa.Array.from_buffers(
                    pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
                n = len(place)
                yield pa.RecordBatch.from_pydict({
                    "pretoken": pa.array(t.spell(place), pa.string()), "salt": pa.array(salt, pa.int16()),
                    "first": pa.array(np.full(n, first)), "narrow": pa.array(np.full(n, narrow)),
                    "rows": packed_column})

    return run


def _counted_sums(tokenizer: str):
    """Count the pieces of each pre-token once, meet them with its documents, add up per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)

        def joined():
            last, pieces = None, 0
            for batch in batches:          # sorted by pre-token
                runs = pa.compute.run_end_encode(batch.column(0))
                words = runs.values.to_pylist()
                fresh = words[1:] if words and words[0] == last else words
                counts = [len(x) for x in coder.encode_each(fresh)]
                counts = counts if fresh is words else [pieces, *counts]
                if words:
                    last, pieces = words[-1], counts[-1]
                ends = runs.run_ends.to_numpy()
                each = np.repeat(np.array(counts, np.int64), np.diff(ends, prepend=0))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in ("first", "narrow", "rows")), pa.array(each)],
                    ["first", "narrow", "rows", "pieces"])

        yield from _partial_sums(joined())

    return run


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up pieces per document over the rows that a task holds, some at a time."""
    held, uids, sums, firsts = 0, [], [], []
    for batch in batches:
        first, pieces = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        narrow = batch.column(1).to_numpy(zero_copy_only=False)
        column = batch.column(2)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)
        for flag, kind in ((True, [("row", "<u2"), ("times", "u1")]), (False, [("row", "<u4"), ("times", "<u4")])):
            at = np.flatnonzero(narrow == flag)
            if not len(at):
                continue
            sizes = offsets[at + 1] - offsets[at]
            packed = raw[spans(offsets[at], sizes)].view(kind)
            each = sizes // packed.dtype.itemsize
            firsts.append(np.repeat(first[at], each))
            uids.append(firsts[-1] + packed["row"])
            sums.append(np.repeat(pieces[at].astype(np.int64), each) * packed["times"])
            held += len(packed)
        if held >= 4_000_000:
            yield _summed(uids, sums, firsts)
            held, uids, sums, firsts = 0, [], [], []
    if held:
        yield _summed(uids, sums, firsts)


_SUM = [("row", "<u4"), ("n", "<i8")]


def _summed(uids: list[np.ndarray], sums: list[np.ndarray], firsts: list[np.ndarray]) -> pa.RecordBatch:
    """One row per block: its documents' partial sums, packed."""
    uid, first = np.concatenate(uids), np.concatenate(firsts)
    key, place, number = np.unique(uid, return_index=True, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, number, np.concatenate(sums))
    block = first[place]                      # ascends with the documents
    packed = np.zeros(len(key), _SUM)
    packed["row"], packed["n"] = key - block, total
    at = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    ends = np.append(at[1:], len(block))
    return pa.RecordBatch.from_pydict({
        "first": pa.array(block[at]),
        "sums": pa.array([packed[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist())], pa.binary())})


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the partial sums of each block; rows are sorted by block."""
    block, total = None, np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        row = np.flatnonzero(total)
        return pa.RecordBatch.from_pydict({"uid": pa.array(block + row), "n": pa.array(total[row])})

    for batch in batches:
        for first, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if first != block:
                if block is not None:
                    yield done()
                block, total = first, np.zeros(0, np.int64)
            part = np.frombuffer(raw.as_buffer(), _SUM)
            if len(part) and part["row"].max() >= len(total):
                total = np.concatenate([total, np.zeros(int(part["row"].max()) + 1 - len(total), np.int64)])
            total[part["row"]] += part["n"]      # a document is once in a part
    if block is not None:
        yield done()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    each; other columns are not read.

    One shuffle brings together what blocks of documents say of a pre-token, in
    sorted order, so its pieces are counted once, whatever the number of blocks;
    a pre-token that very many documents have is split into ``SALTS`` parts. A
    second, small one brings together the packed sums of each block. The table is scanned twice: for the
    frequencies and for the result's rows.
    """
    plain = numbered(docs.select(quoted(id_column).alias("doc_id"), quoted(text_column).alias("text")))
    have = plain.select("uid", "text").mapInArrow(
        _frequencies(tokenizer), "pretoken string, salt short, first long, narrow boolean, rows binary")
    placed = have.repartition("pretoken", "salt").sortWithinPartitions("pretoken")
    parts = placed.mapInArrow(_counted_sums(tokenizer), "first long, sums binary")
    total = parts.repartition("first").sortWithinPartitions("first").mapInArrow(_block_sums, "uid long, n long")
    rows = plain.select("uid", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.join(total, "uid", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
