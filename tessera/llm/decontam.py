"""Benchmark decontamination by winnowing.

Every window of ``span`` consecutive words has ``span - k + 1`` word k-grams; both
sides keep the smallest k-gram hash of each window, the rightmost of equal ones. What
is kept depends on the window alone, so a span of ``span`` shared words shares a
fingerprint and none is missed. A window of a document whose fingerprint the benchmark
has is extended to the whole window: its hash is looked up among the benchmark's
windows, and its words are compared, byte by byte. Neighbouring hits make spans. An
item of fewer words is one window, and its first word the fingerprint.

Words: letters A-Z lower-cased, runs of ASCII letters, digits and non-ASCII.
Null and word-free texts have no words, are never hit and are not contaminated;
word-free items never occur. Equal items all count, and rows that repeat a doc_id
are judged each by its own text. Extra columns are ignored, whatever their names. A
text or an item of any length takes time and memory in proportion to it, also where a
word or a passage repeats in it. An empty benchmark hits nothing, an empty table gives
no rows.

Plan: a benchmark of at most ``block_bytes``, which is measured first, is indexed by
the driver and broadcast; documents are scanned once and never shuffled. A larger one
never reaches the driver: its windows are a table, a filter of fixed size lets the
scan of the documents send only windows that may occur, and these meet the table by
hash and words. A passage that is in very many documents is then on one key, whose
documents Spark can split, as a window is one row on the other side.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .runtime import attach, ship, stored

RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>,"
    " spans array<struct<first:int,last:int>>, contaminated boolean"
)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if K.ALNUM[b] else 32 for b in range(256))
#: Bits of the filter for a fingerprint, at most, and bytes of a page of it.
FILTER_BITS, MOST_FILTER_BITS, PAGE = 16, 1 << 29, 1 << 16
_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _rightmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the minimum of each w consecutive values, the rightmost of equal ones."""
    have, at = 1, np.arange(len(x))
    while have < w:
        step = min(have, w - have)
        left, right = at[: max(len(at) - step, 0)], at[step:]
        at = np.where(x[right] <= x[left], right, left)
        have += step
    return at


class Batch:
    """Words of a batch of texts, and their windows."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        words = K.Words(texts, K.ALNUM)
        self.n, self.first, self.h = words.n, words.first, words.hashes()
        self._lens, self._held = words.end - words.start, {}

    def windows(self, k: int, n: int, known=None):
        """First word, hash and fingerprint of each window of n words, of those whose fingerprint is ``known``.

        k: words of a fingerprint; 0: the first word alone is it.
        """
        ok = K.gram_starts(self.first, self.n, n, len(self.h))
        start = np.flatnonzero(ok)
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if k:
            g = K.grams(self.h, k)
            mark = g[_rightmost_min(g, n - k + 1)[start]]
        else:
            mark = self.h[start]
        if known is not None:
            keep = known(mark)
            start, mark = start[keep], mark[keep]
        return start, K.grams(self.h, n)[start], mark

    def owner(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, start, "right") - 1

    def words(self, doc: int, start: int, n: int) -> bytes:
        """n words of a text, lower-cased, with a space between."""
        if doc not in self._held:
            ends = np.cumsum(self._lens[self.first[doc] : self.first[doc + 1]] + 1)
            self._held = {doc: (b" ".join(self.texts[doc].translate(_FOLD).split()), [0, *ends.tolist()])}
        text, edge = self._held[doc]
        i = int(start - self.first[doc])
        return text[edge[i] : edge[i + n] - 1]


def _sizes(k: int, span: int, short) -> list[tuple[int, int]]:
    """(words of a window, words of its fingerprint or 0 for the first word alone)."""
    return [(span, k), *((n, 0) for n in sorted(short))]


def _item_windows(items: list[bytes], k: int, span: int):
    """For each size of windows: size, batch, and (first word, hash, fingerprint, item number) of the items' windows."""
    batch = Batch(items)
    for n, mark in _sizes(k, span, {int(x) for x in batch.n if 0 < x < span}):
        start, key, fp = batch.windows(mark, n)
        own = batch.owner(start)
        use = batch.n[own] >= span if n == span else batch.n[own] == n
        yield n, batch, start[use], key[use], fp[use], own[use]


class Index:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], k: int, span: int):
        self.k, self.span = k, span
        same: dict[bytes, list[str]] = defaultdict(list)
        for name, text in items:
            same[b" ".join(text.translate(_FOLD).split())].append(name)
        texts = list(same)
        self.names, self.sizes, raw, at = list(same.values()), [], [], 0
        for n, batch, start, key, fp, own in _item_windows(texts, k, span):
            if not len(start):
                continue
            order = np.lexsort((own, key))
            key, start, own = key[order], start[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            kept, members, begin, other = [], [], [], defaultdict(list)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                one = batch.words(own[a], start[a], n)
                kept.append(one)
                begin.append(len(members))
                members.append(int(own[a]))
                for i in range(a + 1, b):
                    if (two := batch.words(own[i], start[i], n)) != one:  # equal hashes of other words are kept apart
                        other[two].append(int(own[i]))
                    elif own[i] != members[-1]:
                        members.append(int(own[i]))
            ends = np.cumsum([len(x) for x in kept])
            raw.append(b"".join(kept))
            self.sizes.append(dict(n=n, mark=k if n == span else 0, fps=np.unique(fp), keys=key[first], base=at, edge=np.concatenate([[0], ends]), items=np.array(members, np.int32), begin=np.array([*begin, len(members)]), other=dict(other)))
            at += len(raw[-1])
        self.raw = b"".join(raw)

    def find(self, texts: list[bytes]):
        """For each text: number of words; hit mask of its words, and indices of items that occur, of those with hits."""
        batch = Batch(texts)
        cover = np.zeros(len(batch.h) + 1, np.int32)
        found: dict[int, set[int]] = defaultdict(set)
        for s in self.sizes:
            start, key, _ = batch.windows(s["mark"], s["n"], lambda x, s=s: np.isin(x, s["fps"]))
            at = np.minimum(np.searchsorted(s["keys"], key), len(s["keys"]) - 1)
            some = s["keys"][at] == key
            start, at = start[some], at[some]
            met = set()
            for p, w, d in zip(start.tolist(), at.tolist(), batch.owner(start).tolist(), strict=True):
                words = batch.words(d, p, s["n"])
                if words == self.raw[s["base"] + s["edge"][w] : s["base"] + s["edge"][w + 1]]:
                    met.add((d, w))
                elif words in s["other"]:
                    found[d].update(s["other"][words])
                else:
                    continue
                cover[p] += 1
                cover[p + s["n"]] -= 1
            for d, w in met:
                found[d].update(s["items"][s["begin"][w] : s["begin"][w + 1]].tolist())
        mask = np.cumsum(cover[:-1]) > 0
        return batch.n, {d: mask[batch.first[d] : batch.first[d + 1]] for d in found}, found


def _runs(mask: np.ndarray) -> list[dict]:
    m = np.concatenate([[False], mask, [False]])
    e = np.flatnonzero(m[1:] != m[:-1])
    return [{"first": int(x), "last": int(y) - 1} for x, y in zip(e[0::2], e[1::2], strict=True)]


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    span: int = 13,
    carry: list[str] | None = None,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Columns ``c`` (the carried columns, by default the id) and ``r`` (see RESULT); a row for each document row.

    spans are maximal runs of hit words (word numbers, both inclusive);
    contaminated: hit words are at least a twentieth of all words, and not none.
    Items without an id count as one in n_items and are not in items.
    """
    ship(docs.sparkSession)
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    items = bench.select(q(item_col).cast("string").alias("item"), q(item_text_col).alias("text")).where("text is not null")
    carry = list(carry or [id_col])
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > block_bytes:
        return _by_shuffle(docs, items, text_col, carry, k, span)
    index = Index([(r.item, r.text.encode()) for r in items.sort("item", "text").collect()], k, span)

    def fn(cols):
        out = {x: [] for x in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")}
        texts = K.utf8(cols[text_col])
        for a, b in K.batches(texts):
            n, hits, found = index.find(texts[a:b])
            for d in range(b - a):
                names = {x for i in found.get(d, ()) for x in index.names[i]}
                hit = int(hits[d].sum()) if d in hits else 0
                row = (int(n[d]), hit, len(names), sorted(names - {None}), _runs(hits[d]) if d in hits else [], hit > 0 and 20 * hit >= int(n[d]))
                for key, v in zip(out, row, strict=True):
                    out[key].append(v)
        return out

    return attach(docs, [text_col], carry, fn, RESULT)


# A benchmark of any size ---------------------------------------------------------------

_WINDOW = pa.schema([("n", pa.int32()), ("fp", pa.int64()), ("key", pa.int64()), ("win", pa.binary()), ("item", pa.string())])
WINDOW = "n int, fp long, key long, win binary, item string"


def _marked(fp: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of windows of different sizes are different."""
    return K.mix(fp ^ np.uint64(n))


def _places(fp: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([K.mix(fp * p) % np.uint64(bits) for p in _PROBES]).astype(np.int64)


def _filter(fps: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the column ``fp``, and its bits; pages are joined by tasks, at most 64 MB reach the driver."""
    bits = 8 * PAGE
    want = min(max(fps.count() * FILTER_BITS, bits), MOST_FILTER_BITS)
    while bits < want:
        bits *= 2

    def own(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pages = held.reshape(-1, PAGE)
        for i in np.flatnonzero(pages.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pages[i].tobytes()], pa.binary())], ["page", "data"])

    def joined(table: pa.Table) -> pa.Table:
        out = np.zeros(PAGE, np.uint8)
        for x in table["data"]:
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    held = bytearray(bits // 8)
    for r in fps.select("fp").mapInArrow(own, "page int, data binary").groupBy("page").applyInArrow(joined, "page int, data binary").toLocalIterator():
        held[r.page * PAGE : (r.page + 1) * PAGE] = r.data
    return bytes(held), bits


def _windows_of(items: DataFrame, k: int, span: int) -> DataFrame:
    """WINDOW: a row for each distinct window of each item."""

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), K.utf8(batch.column(1))
            for a, b in K.batches(texts):
                for n, own, start, key, fp, item in _item_windows(texts[a:b], k, span):
                    if not len(start):
                        continue
                    fp, rows = _marked(fp, n).view(np.int64), {}
                    for j, (p, i) in enumerate(zip(start.tolist(), item.tolist(), strict=True)):
                        rows.setdefault((i, own.words(i, p, n)), j)
                    at = np.fromiter(rows.values(), np.int64, len(rows))
                    cols = [pa.array(np.full(len(at), n, np.int32)), pa.array(fp[at]), pa.array(key.view(np.int64)[at]), pa.array([w for _, w in rows], pa.binary()), pa.array([names[a + i] for i, _ in rows], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema=_WINDOW)

    return items.mapInArrow(run, WINDOW)


def _by_shuffle(docs: DataFrame, items: DataFrame, text_col: str, carry: list[str], k: int, span: int) -> DataFrame:
    windows = stored(_windows_of(items, k, span), "windows")
    held, bits = _filter(windows.select("fp").distinct())
    known = docs.sparkSession.sparkContext.broadcast(held)
    short = [r.n for r in windows.where(F.col("n") < span).select("n").distinct().collect()]  # fewer than span numbers

    def fn(cols):
        table = np.frombuffer(known.value, np.uint8)
        texts, sizes, out = K.utf8(cols[text_col]), [], []
        for a, b in K.batches(texts):
            batch = Batch(texts[a:b])
            sizes += batch.n.tolist()
            met: list[dict[tuple, list]] = [defaultdict(list) for _ in range(b - a)]
            for n, mark in _sizes(k, span, short):

                def may(fp, n=n):
                    at = _places(_marked(fp, n), bits)
                    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)

                start, key, _ = batch.windows(mark, n, may)
                for p, x, d in zip(start.tolist(), key.view(np.int64).tolist(), batch.owner(start).tolist(), strict=True):
                    met[d][x, n, batch.words(d, p, n)].append(p - int(batch.first[d]))
            out += [[{"key": x, "n": n, "win": w, "at": at} for (x, n, w), at in m.items()] for m in met]
        return {"n_words": sizes, "met": out}

    # the row number is stored with its row, so that it stays the same
    seen = attach(docs, [text_col], carry, fn, "n_words long, met array<struct<key:long,n:int,win:binary,at:array<int>>>")
    seen = stored(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    table = stored(windows.groupBy("key", "win").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless")), "bench")
    hits = seen.select("row", F.explode("r.met").alias("m")).select("row", "m.*").join(table, ["key", "win"])
    per = hits.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("nameless").alias("nameless"),
        F.flatten(F.collect_list(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("n") - 1))))).alias("places"),
    )
    joined = seen.select("row", "c", F.col("r.n_words").alias("n_words")).join(stored(per, "hits"), "row", "left")
    none = F.array().cast("array<int>")
    joined = joined.withColumn("places", F.array_sort(F.array_distinct(F.coalesce("places", none))))
    starts = F.filter("places", lambda p, i: (i == 0) | (F.get("places", i - 1) != p - 1))
    ends = F.filter("places", lambda p, i: F.coalesce(F.get("places", i + 1) != p + 1, F.lit(True)))
    hit = F.size("places").cast("long")
    r = F.struct(
        "n_words",
        hit.alias("n_hit"),
        (F.coalesce(F.size("items"), F.lit(0)) + F.coalesce(F.col("nameless").cast("int"), F.lit(0))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("spans"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )
    return joined.select("c", r.alias("r"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op5(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "c.doc_id",
        "r.n_words",
        "r.n_hit",
        "r.n_items",
        F.sha2(F.concat_ws(",", "r.items"), 256).alias("items_sha256"),
        "r.contaminated",
    )
