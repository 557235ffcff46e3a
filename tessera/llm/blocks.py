"""Blocks of documents, and a shuffle of their distinct keys there and back.

Several operators need, for every word, n-gram or passage of every document, a
value that depends on the whole corpus. Shuffling one row for each occurrence
costs many times the input. Here documents are packed into blocks of a few MB
(compressed), each block sends every distinct key once, split by key range into
pieces, a task for each range answers all its pieces, and the answers meet the
block's documents again by block number. Skew vanishes twice: a key that occurs
in every document is sent once by each block, and ranges are of mixed hashes.

Blocks are formed in the order in which a partition of the input yields rows,
so the input has to be re-readable in the same order: a file scan or a stored
table. Every piece carries a checksum of its keys, which comes back with the answer;
a block whose second reading differs fails and gives no wrong rows. Nulls are empty
texts; ids may be null and may repeat, a row is known by its place in its block.

Tasks of all exchanges grow with the input, so none of them does. A block sends a
piece to each range at most, and ranges grow with the input, too: pieces are few bytes
each beyond some ten TB. ``MOST`` is then to be raised (a block's memory is some
twenty times its text), so that a piece keeps a few dozen keys.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block.
MOST = 4 << 20
BLOCK = "block long, ids array<long>, lens binary, data binary"
PIECE = "part int, block long, n int, keys binary, vals binary, sum long"
ANSWER = "block long, part int, kind int, vals binary, sum long"
_BLOCK_TYPE = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("data", pa.binary())])
_PIECE_TYPE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("sum", pa.int64())])
_ANSWER_TYPE = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("vals", pa.binary()), ("sum", pa.int64())])


def squeeze(data: bytes | np.ndarray, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(x: np.ndarray) -> bytes:
    """A number array by byte planes, compressed: small numbers cost little more than their low bytes."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), 1)


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def trim() -> None:
    """Give freed memory back; workers are kept for other tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def formed(batches, most: int):
    """(block number, ids, texts) of a partition."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            t = t.as_py() or b""
            if ids and held + len(t) > most:
                yield number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield number, ids, texts


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("text"))


def pack(docs: DataFrame, id_col: str, text_col: str, most: int = MOST, level: int = 3) -> DataFrame:
    """Blocks of at most ``most`` text bytes, or of one longer text, compressed."""

    def run(batches):
        for number, ids, texts in formed(batches, most):
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            row = dict(block=number, ids=ids, lens=planes(lens), data=squeeze(b"".join(texts), level))
            yield pa.RecordBatch.from_pylist([row], _BLOCK_TYPE)

    return columns(docs, id_col, text_col).mapInArrow(run, BLOCK)


def pieces(docs: DataFrame, id_col: str, text_col: str, emit, most: int = MOST) -> DataFrame:
    """``emit(ids, texts)`` yields (part, n, keys, vals, checksum) for each of the blocks that ``pack`` forms."""

    def run(batches):
        for number, ids, texts in formed(batches, most):
            out = [dict(part=p, block=number, n=n, keys=k, vals=v, sum=s) for p, n, k, v, s in emit(ids, texts)]
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[a : a + 256], _PIECE_TYPE)
            out = None
            trim()

    return columns(docs, id_col, text_col).mapInArrow(run, PIECE)


def unpack(row: dict) -> tuple[list, list[bytes]]:
    lens, data = unplanes(row["lens"], np.int64), unsqueeze(row["data"])
    ends = np.cumsum(lens).tolist()
    return row["ids"], [data[e - n : e] for e, n in zip(ends, lens.tolist(), strict=True)]


def ranges(docs: DataFrame, times: int = 4) -> int:
    """Bits of the key range number: so many ranges as input partitions, ``times`` over."""
    n = max(docs.rdd.getNumPartitions(), 1)
    return max(4, (n * times - 1).bit_length())


def tasks(docs: DataFrame) -> int:
    """Tasks of an exchange of blocks or pieces: in proportion to the input, so that none grows with it."""
    return max(2 * docs.rdd.getNumPartitions(), 16)


def parts_of(keys: np.ndarray, bits: int):
    """(part, slice) of sorted uint64 keys."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)], strict=True):
        if b > a:
            yield int(part[a]), slice(a, b)


def checksum(keys: np.ndarray) -> int:
    return zlib.crc32(keys.tobytes())


def same_reading(keys: np.ndarray, bits: int, sums: dict[int, int]) -> None:
    """An error unless the sorted keys of a block are those that it has sent."""
    if {p: checksum(keys[s]) for p, s in parts_of(keys, bits)} != sums:
        raise ValueError("the input changed between its two readings; store it first")


def answers(sent: DataFrame, reduce, tasks: int) -> DataFrame:
    """``reduce(pieces)`` gets all pieces of a key range and yields (block, kind, vals)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        part, sums = rows[0]["part"], {r["block"]: r["sum"] for r in rows}
        out = pa.Table.from_pylist([dict(block=b, part=part, kind=k, vals=v, sum=sums.get(b)) for b, k, v in reduce(rows)], _ANSWER_TYPE)
        rows = None
        trim()
        return out

    return sent.repartition(tasks, "part").groupBy("part").applyInArrow(run, ANSWER)


def by_kind(given: pa.Table) -> dict[int, dict[int, bytes]]:
    """{kind: {part: vals}} of a block's answers; kind -1: checksums of the keys of kind 0."""
    by: dict[int, dict] = {-1: {}}
    for r in given.to_pylist():
        by.setdefault(r["kind"], {})[r["part"]] = r["vals"]
        if r["kind"] == 0:
            by[-1][r["part"]] = r["sum"]
    return by


def together(blocks: DataFrame, answered: DataFrame, work, schema: str, tasks: int) -> DataFrame:
    """``work(ids, texts, answers)`` gets a block and its answers (see ``by_kind``), and returns an Arrow table."""

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        by = by_kind(given)
        (row,) = block.to_pylist()
        out = work(*unpack(row), by)
        row = by = None
        trim()
        return out

    held, given = blocks.repartition(tasks, "block"), answered.where("block >= 0").repartition(tasks, "block")
    return held.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, schema)
