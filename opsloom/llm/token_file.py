"""Token ids in files: every id takes the fewest bits that the vocabulary needs.

One file (all numbers little-endian)::

    packed    blocks of ids, each padded to whole bytes
    8 x n     start of each block in bytes, and the end of the last one
    8 x d     number of ids of each document
    8 x d     doc_id of each document; the smallest number stands for none
    8 bytes   mark TOKBITS1
    8 x 5     bits per id, ids per block, ids, documents, bytes of packed ids

An id's block follows from its number, so any range of ids is read from the
few blocks that hold it, and a block is unpacked at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.arrow import text_pieces
from opsloom.llm.pretokens import encoder
from opsloom.llm.store import kept, quoted
from opsloom.session import new_scratch

MARK = b"TOKBITS1"
HEAD = 48      # bytes of mark and numbers at the end
BLOCK = 4096
NO_ID = -(1 << 63)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` bits each, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for j in range(bits):
        out |= planes[:, j].astype(np.uint32) << np.uint32(j)
    return out


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder given as URI or absolute path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenWriter:
    """Writes one file, a block at a time."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.lengths: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.tail = np.zeros(0, np.uint32)
        self.starts, self.size, self.ids = [0], 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> None:
        self.lengths.append(lengths)
        self.names.append(names)
        ids = np.concatenate([self.tail, ids])
        whole = len(ids) - len(ids) % BLOCK
        for low in range(0, whole, BLOCK):
            self._block(ids[low:low + BLOCK])
        self.tail = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.stream.write(raw)
        self.size += len(raw)
        self.ids += len(ids)
        self.starts.append(self.size)

    def close(self) -> dict[str, int]:
        if len(self.tail):
            self._block(self.tail)
        lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        names = np.concatenate([np.zeros(0, np.int64), *self.names])
        for table in (np.array(self.starts), lengths, names):
            self.stream.write(table.astype("<i8").tobytes())
        head = np.array([self.bits, BLOCK, self.ids, len(lengths), self.size], "<i8").tobytes()
        self.stream.write(MARK + head)
        self.stream.close()
        return {"ids": self.ids, "documents": len(lengths)}


class TokenReader:
    """Reads parts of one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        head = self.file.read_at(HEAD, end - HEAD)
        if head[:8] != MARK:
            raise ValueError(f"not a token file: {uri}")
        self.bits, self.block, self.ids, self.documents, self.size = np.frombuffer(head[8:], "<i8").tolist()
        blocks = -(-self.ids // self.block)
        rest = np.frombuffer(self.file.read_at(end - HEAD - self.size, self.size), "<i8")
        self.starts, rest = rest[:blocks + 1], rest[blocks + 1:]
        self.lengths, self.names = rest[:self.documents], rest[self.documents:]

    def read(self, low: int, high: int) -> np.ndarray:
        """The ids low..high, from the blocks that hold them."""
        if high <= low:
            return np.zeros(0, np.uint32)
        first, last = low // self.block, (high - 1) // self.block
        raw = self.file.read_at(int(self.starts[last + 1] - self.starts[first]), int(self.starts[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.ids - b * self.block)
            parts.append(unpack_bits(raw[self.starts[b] - self.starts[first]:self.starts[b + 1] - self.starts[first]],
                                     self.bits, n))
        ids = np.concatenate(parts)
        return ids[low - first * self.block:high - first * self.block]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text and write token files in ascending id order.

    Returns the manifest, one row per file: shard, path, ids, documents, start
    (ids in all files before it). A task writes under a name of its own and only
    files named in the manifest count, so a task that runs again does no harm.

    Null texts are empty; ``end_id`` follows each document. Rows without id come
    first; rows with one id stand in the order of their text's hash, and
    repeated rows are written each. No rows give no files. Other columns are
    not read.
    """
    bits = bits_for(max(encoder(tokenizer).size, (end_id or 0) + 1))
    store, path = open_store(folder)
    store.create_dir(path)
    placed = (docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).alias("text"))
              .repartitionByRange("doc_id", F.xxhash64("text"))
              .sortWithinPartitions("doc_id", F.xxhash64("text")))
    made = kept(placed.mapInArrow(_write(folder.rstrip("/"), tokenizer, bits, end_id),
                                  "shard long, path string, ids long, documents long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def _write(folder: str, tokenizer: str, bits: int, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        coder = encoder(tokenizer)
        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_numpy()
            for low, high, raw, offsets in text_pieces(batch.column(1)):
                if writer is None:
                    store, root = open_store(folder)
                    name = f"part-{shard:06d}-{uuid.uuid4().hex}.tok"
                    writer = TokenWriter(store.open_output_stream(f"{root}/{name}"), bits)
                ids, lengths = coder.ids(raw, offsets)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                writer.add(ids, lengths, names[low:high])
        if writer is not None:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "path": [f"{folder}/{name}"], "ids": [done["ids"]],
                "documents": [done["documents"]]})

    return run


def read_tokens(manifest: DataFrame, documents_at_once: int = 4096) -> DataFrame:
    """One row per document of the files: doc_id, start, ids (array).

    Work is split by ranges of documents, so a large file is read by many tasks.
    """
    return _ranges(manifest, documents_at_once).mapInArrow(
        _read(lambda ids: pa.array(list(ids), pa.list_(pa.int64())), "ids"),
        "doc_id long, start long, ids array<long>")


def token_digests(manifest: DataFrame, documents_at_once: int = 4096) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    return _ranges(manifest, documents_at_once).mapInArrow(
        _read(lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32",
              True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ranges(manifest: DataFrame, step: int) -> DataFrame:
    ranges = manifest.filter("documents > 0").select(
        "path", "start", F.explode(F.expr(f"sequence(0L, documents - 1, {step}L)")).alias("low"),
        F.lit(step).cast("long").alias("step"))
    return ranges.repartition("path", "low")


def _read(value, name: str, counted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    reader = TokenReader(path)
                low, high = row["low"], min(row["low"] + row["step"], reader.documents)
                ends = np.cumsum(reader.lengths[:high])
                begin = ends[low:high] - reader.lengths[low:high]
                names = reader.names[low:high]
                for a in range(0, high - low, 256):     # some documents at a time
                    b = min(a + 256, high - low)
                    ids = reader.read(int(begin[a]), int(ends[low + b - 1]))
                    each = np.split(ids, np.cumsum(reader.lengths[low + a:low + b])[:-1])
                    columns = {"doc_id": pa.array(names[a:b], mask=names[a:b] == NO_ID),
                               "start": pa.array(begin[a:b] + row["start"])}
                    if counted:
                        columns["n_tokens"] = pa.array(reader.lengths[low + a:low + b])
                    yield pa.RecordBatch.from_pydict(columns | {name: value(each)})

    return run


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files to the shared folder and report each document as read back."""
    folder = new_scratch(docs.sparkSession, "tokens")
    return token_digests(write_tokens(docs, tokenizer, folder, **options))
