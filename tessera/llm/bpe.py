"""Byte-level BPE: encoding through a shuffle of distinct words, and decoding.

Encoding splits each text into pre-tokens, in order. A block of documents becomes
the numbers of its pre-tokens, position by position, and its distinct pre-tokens;
these are shuffled by their hash, so that each distinct pre-token of the corpus is
encoded in one task, once (a task that has met ``MOST_DONE`` bytes of them forgets
them and goes on). The ids join back to the block's positions. Decoding joins ids
with the table of token bytes; the table is bounded by the vocabulary file, whose
size is checked before it is broadcast. An id outside the table is an error.

A task holds a block, or a batch of pieces, never a group. There are at most
``MOST_PARTS`` ranges of the hash, so rows grow in proportion to the input beyond
some hundred GB, and below with at most as many for a block.

Null texts are empty, and empty texts have no ids. A text of any length is encoded
whole; long ones are split lazily and are a block of their own. Rows that repeat a
doc_id, with equal or other texts, give a row each; a null doc_id stays null. There
are no ties: of pairs of equal rank the leftmost merges first. Extra columns are
ignored, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import blocks as B
from .runtime import ship

MOST_VOCABULARY_BYTES = 64 << 20
#: Text bytes of a block, ranges of the hash, bytes of encoded words that a task remembers, ids of a batch of rows.
MOST, MOST_PARTS, MOST_DONE, MOST_IDS = 8 << 20, 4096, 16 << 20, 1 << 18
#: Texts of more characters are split lazily; words of more bytes are merged with a heap.
LONG_TEXT, LONG_WORD = 1 << 19, 48

_vocabularies: dict[tuple, Vocabulary] = {}


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes; it would be broadcast")
    return data


def ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Vocabulary:
    """Ranks of token bytes, and the table of bytes of each id."""

    def __init__(self, data: bytes):
        self.ranks = ranks(data)
        words: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for w, i in self.ranks.items():
            words[i] = w
        self.known = np.array([w is not None for w in words], bool)
        self.n = np.array([len(w or b"") for w in words], np.int64)
        self.flat = np.frombuffer(b"".join(w or b"" for w in words), np.uint8)
        self.start = np.cumsum(self.n) - self.n

    @staticmethod
    def of(data: bytes) -> Vocabulary:
        """Made once by a worker."""
        key = (zlib.crc32(data), len(data))
        if key not in _vocabularies:
            _vocabularies[key] = Vocabulary(data)
        return _vocabularies[key]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the pair of neighbours whose bytes have the lowest rank merges, the leftmost first."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        cuts = self._cuts(word) if len(word) <= LONG_WORD else self._cuts_of_long(word)
        return [self.ranks[word[a:b]] for a, b in pairwise(cuts)]

    def _cuts(self, word: bytes) -> list[int]:
        get, never = self.ranks.get, 1 << 62
        cuts = list(range(len(word) + 1))
        cost = [get(word[i : i + 2], never) for i in range(len(word) - 1)]
        while cost and (low := min(cost)) != never:
            i = cost.index(low)
            del cuts[i + 1], cost[i]
            if i < len(cost):
                cost[i] = get(word[cuts[i] : cuts[i + 2]], never)
            if i:
                cost[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], never)
        return cuts

    def _cuts_of_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs, so that a word of n bytes takes n log n steps."""
        n, get, heap = len(word), self.ranks.get, []
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; end is 0 when it is gone

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n and (r := get(word[a : end[end[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[end[a]]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            mid = end[a]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two has merged since
            end[a], end[mid] = stop, 0
            if stop < n:
                before[stop] = a
            offer(a)
            offer(before[a])
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(end[cuts[-1]])
        return cuts

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The ids' rows of the table of token bytes, one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return _take(self.flat, self.start[ids], self.n[ids]).tobytes()


# The usual pattern of byte-level BPE, and the same for texts of plain characters
# (ASCII without control characters but white space, and Latin letters), where classes are ranges.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = rf"""'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def splitter(pattern: str):
    """A function that gives a text's pre-tokens in order: a list, or for a long text an iterator."""
    import regex

    full = regex.compile(pattern)
    if pattern == USUAL:
        odd, plain = re.compile(rf"[^\t-\r\x20-\x7e{LATIN}]").search, re.compile(PLAIN)
    else:
        odd, plain = bool, full

    def split(text: str):
        p = full if odd(text) else plain
        return p.findall(text) if len(text) < LONG_TEXT else (m[0] for m in p.finditer(text))

    return split


def _words_out(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return lens.tobytes() + b"".join(words)


def _words_in(raw: bytes, n: int) -> list[bytes]:
    lens, at, out = np.frombuffer(raw, np.uint32, n).tolist(), 4 * n, []
    for k in lens:
        out.append(raw[at : at + k])
        at += k
    return out


def _take(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start[0]:start[0]+n[0]] and so on, one after another."""
    total = int(n.sum())
    shift = np.repeat(start - (np.cumsum(n) - n), n)
    return values[shift + np.arange(total)]


def _numbered(texts: list[bytes], split, parts: int):
    """Numbers of each text's pre-tokens, the distinct pre-tokens by number, and the range of each."""
    place = defaultdict()
    place.default_factory = place.__len__
    number = place.__getitem__
    seqs = []
    for t in texts:
        words = split(t.decode())
        seqs.append(np.fromiter(map(number, words), np.uint32, len(words) if isinstance(words, list) else -1))
    place.default_factory = None
    words = [w.encode() for w in place]
    return seqs, words, np.fromiter((zlib.crc32(w) % parts for w in words), np.uint16, len(words))


def _pieces(words: list[bytes], part: np.ndarray):
    """(range, its words in order of their numbers, as bytes)."""
    order = np.argsort(part, kind="stable")
    at, first = np.unique(part[order], return_index=True)
    for p, k in zip(at.tolist(), np.split(order, first[1:]), strict=True) if len(at) else ():
        yield p, len(k), _words_out([words[i] for i in k.tolist()])


_POSITIONS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("seq", pa.binary()), ("parts", pa.binary()), ("sums", pa.binary())])
_WORDS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])
_ENCODED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("sum", pa.int64()), ("n", pa.binary()), ("ids", pa.binary())])
POSITIONS = "block long, ids array<long>, n binary, seq binary, parts binary, sums binary"
WORDS = "part int, block long, n int, words binary"
ENCODED = "block long, part int, sum long, n binary, ids binary"


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, token_ids: one row for each document row; ``decoded`` adds the bytes that the ids stand for, as ``decode`` does."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(read_ranks(rank_file))
    columns = B.columns(docs, id_col, text_col)
    parts = max(16, min(2 * docs.rdd.getNumPartitions(), MOST_PARTS))

    def positions(batches):
        split = splitter(pattern)
        for block, ids, texts in B.formed(batches, MOST):
            seqs, words, part = _numbered(texts, split, parts)
            sums = [zlib.crc32(raw) for _, _, raw in _pieces(words, part)]
            row = dict(block=block, ids=ids, n=B.planes(np.array([len(s) for s in seqs], np.int64)), seq=B.planes(np.concatenate(seqs)), parts=B.planes(part), sums=np.array(sums, np.uint32).tobytes())
            yield pa.RecordBatch.from_pylist([row], _POSITIONS)
            seqs = words = part = row = None
            B.trim()

    def distinct(batches):
        split = splitter(pattern)
        for block, _, texts in B.formed(batches, MOST):
            _, words, part = _numbered(texts, split, parts)
            rows = [dict(part=p, block=block, n=n, words=B.squeeze(raw)) for p, n, raw in _pieces(words, part)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _WORDS)
            words = part = rows = None
            B.trim()

    def encoded(batches):
        vocabulary = Vocabulary.of(held.value)
        done: dict[bytes, list[int]] = {}
        bytes_done = 0
        for batch in batches:
            rows = []
            for p, block, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, got = B.unsqueeze(blob), []
                for w in _words_in(raw, n):
                    ids = done.get(w)
                    if ids is None:
                        ids = done[w] = vocabulary.merge(w)
                        bytes_done += len(w)
                    got.append(ids)
                size = np.fromiter(map(len, got), np.uint32, n)
                flat = np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))
                rows.append(dict(block=block, part=p, sum=zlib.crc32(raw), n=B.planes(size), ids=B.planes(flat)))
                if bytes_done > MOST_DONE:
                    done, bytes_done = {}, 0
            yield pa.RecordBatch.from_pylist(rows, _ENCODED)
            rows = got = None
            B.trim()

    def joined(block: pa.Table, given: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        got = sorted(given.to_pylist(), key=lambda r: r["part"])
        part = B.unplanes(row["parts"], np.uint16)
        if [r["sum"] for r in got] != np.frombuffer(row["sums"], np.uint32).tolist():
            raise ValueError("the input changed between its two readings; store it first")
        order = np.argsort(part, kind="stable")  # numbers of the words in the order of the pieces
        size, start = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        flat = np.zeros(0, np.uint32)
        if got:
            given_size = np.concatenate([B.unplanes(r["n"], np.uint32) for r in got]).astype(np.int64)
            size[order], start[order] = given_size, np.cumsum(given_size) - given_size
            flat = np.concatenate([B.unplanes(r["ids"], np.uint32) for r in got])
        seq, n = B.unplanes(row["seq"], np.uint32), B.unplanes(row["n"], np.int64)
        ends = np.cumsum(n)
        out, rows, waiting = [], [], 0

        def close():
            sizes = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int32)
            ids = pa.array(np.concatenate([x for _, x in rows]).astype(np.int32))
            cols = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "token_ids": pa.ListArray.from_arrays(pa.array(sizes), ids)}
            if decoded:
                vocabulary = Vocabulary.of(held.value)
                cols["decoded"] = pa.array([vocabulary.bytes_of(x) for _, x in rows], pa.binary())
            out.append(pa.table(cols))

        for i, a, b in zip(row["ids"], (ends - n).tolist(), ends.tolist(), strict=True):
            at = seq[a:b]
            rows.append((i, _take(flat, start[at], size[at])))
            waiting += len(rows[-1][1])
            if waiting >= MOST_IDS:
                close()
                rows, waiting = [], 0
        if rows:
            close()
        got = flat = seq = rows = None
        B.trim()
        return pa.concat_tables(out)

    tasks = B.tasks(docs)
    answers = columns.mapInArrow(distinct, WORDS).repartition(tasks, "part").mapInArrow(encoded, ENCODED).repartition(tasks, "block")
    blocks = columns.mapInArrow(positions, POSITIONS).repartition(tasks, "block")
    schema = "doc_id long, token_ids array<int>" + (", decoded binary" if decoded else "")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, schema)


def decode(tokens: DataFrame, rank_file: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with a binary column of the bytes of its ids (null stays null; a column of that name is replaced)."""
    spark = tokens.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(read_ranks(rank_file))
    tokens = tokens.drop(out_col)
    at = tokens.columns.index(ids_col)

    def run(batches):
        vocabulary = Vocabulary.of(held.value)
        for batch in batches:
            out = [vocabulary.bytes_of(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])
            out = None
            B.trim()

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(out_col, BinaryType())]))


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded=True)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
