"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit: a fixed number of open sequences stands in a
bitset keyed by free space. A piece goes where it leaves the least room; when
it fits nowhere and all places are taken, the fullest sequence closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from opsloom.llm.arrow import text_pieces
from opsloom.llm.pretokens import encoder
from opsloom.llm.store import kept, quoted

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that one packing task gets; its last open sequences stay part-filled.
TASK_PIECES = 65_536
#: Pieces that arrive together; of these the longest are placed first.
ARRIVALS = 2000


class OpenBins:
    """The open sequences of one task."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0                     # bit f: some open sequence has f free places
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``need`` tokens."""
        fitting = self.bits >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.made
            self.made += 1
        rest = free - need
        if rest:
            self.at.setdefault(rest, []).append(bin_)
            self.bits |= 1 << rest
            self.open += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.at[free]
        bin_ = bins.pop(0)
        if not bins:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's ids as pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut, into full pieces; the first may be shorter.
    Null texts are empty; ``end_id`` ends each document; without it a document
    of no ids has no piece. Repeated rows are cut each on their own.
    """
    plain = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).alias("text"))
    return plain.mapInArrow(_cut(tokenizer, end_id, capacity),
                            "doc_id long, piece int, start long, length long, ids_crc32 long")


def _cut(tokenizer: str, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            names = batch.column(0)
            for low, high, raw, offsets in text_pieces(batch.column(1)):
                ids, lengths = coder.ids(raw, offsets)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                ids = ids.astype("<u4")
                n = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                stop = lengths[owner] - (n[owner] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                base = (np.cumsum(lengths) - lengths)[owner]
                raw_ids = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw_ids[4 * a:4 * b])
                       for a, b in zip((base + start).tolist(), (base + stop).tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": names.slice(low, high - low).take(pa.array(owner)),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start),
                    "length": pa.array(stop - start), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                task_pieces: int = TASK_PIECES) -> DataFrame:
    """Place every piece: adds sequence_id and offset.

    ``pieces`` is a written table with doc_id, piece, start, length and
    ids_crc32. Its rows are dealt to tasks by a hash of them all and placed in
    the order of that hash, so equal tables give equal sequences and pieces of
    all sizes are mixed. Each task numbers its own sequences.
    """
    n = max(1, -(-pieces.count() // task_pieces))
    mixed = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = pieces.repartition(n, mixed).sortWithinPartitions(mixed, "doc_id", "piece", "start")
    return dealt.mapInArrow(_place(capacity, open_bins),
                            StructType(pieces.schema.fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def _place(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 33, OpenBins(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(batch.schema.names.index("length")).to_numpy()
            bin_, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for low in range(0, len(lengths), ARRIVALS):
                for i in (low + np.argsort(-lengths[low:low + ARRIVALS], kind="stable")).tolist():
                    bin_[i], offset[i] = bins.place(int(lengths[i]))
            columns = [*batch.columns, pa.array(base + bin_), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY,
                   open_bins: int = OPEN_BINS, **columns: str) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece. See the functions it calls."""
    pieces = kept(token_pieces(docs, tokenizer, end_id, capacity, **columns), "pieces")
    return pack_pieces(pieces, capacity, open_bins)
