"""Substring dedup with a run-length compressed Burrows-Wheeler index.

Every byte that lies in a ``span``-byte string which also starts in a document
of smaller doc_id is removed; strings never cross documents, overlaps count, and
strings are judged on the input. Null texts are empty. A null doc_id counts as
larger than any other; rows that repeat a doc_id do not remove each other's
bytes. Extra columns are ignored.

How it is dealt out. The anchor of a ``span``-byte window is the leftmost
``GRAM``-byte gram of smallest hash in it, so equal windows have equal anchors
at equal places. The windows of one anchor occurrence are consecutive and make
one *passage* of at most 2 * span - GRAM bytes.

1. Each block of documents sends its distinct anchors; anchors of one document
   only are ruled out (a bit for each anchor comes back).
2. Each block sends every distinct passage of the remaining anchors, with its
   smallest doc_id, to the range of the anchor's hash.
3. A task for each range builds the index of its distinct passages
   (``RunLengthIndex``), streams rank and match length of every place from the
   sampled run ends, and takes the smallest document of the places that match
   each other over a whole window.
4. The answers (runs of windows with one smallest document) meet the block's
   documents, where windows with a smaller document than their own are marked.

An anchor or passage in a third of all documents is sent once by each block. An
anchor that occurs more than ``HOT`` times may stand in as many different passages, so
its passages are cut into runs of ``RUN`` windows, and each run goes where the bytes say
that its windows share; equal windows have equal runs, and no range holds all of a
popular anchor. Everything a task holds is bounded by its block or its range of
hashes, and both are more, not larger, with more input. A text of any length is
taken whole, in segments that overlap by a window less one byte. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import textkernels as K
from .runtime import ship, stored

SPAN, GRAM = 50, 16
#: Occurrences from which an anchor's passages are cut into runs, and windows of a run.
HOT, RUN = 1 << 14, 5
LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 22) - 1)
_VALUES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)
_AGAIN = np.uint64(0xA0761D6478BD642F)
_BASE = (0xD6E8FEB86659FD93 // 8) * 8 + 5


class RunLengthIndex:
    """Run-length BWT of a set of strings, with the suffix array sampled at run ends.

    Strings end in end marks below all bytes, ordered by string number, so
    suffixes have one order. Kept are the runs (symbol, start, occurrences
    before), the positions at run ends, and for the suffix that is one byte longer
    than each of these its rank and the bytes it shares with the next suffix. Within a
    run neighbours stay neighbours, so every other match length is one more than
    that of the place after it.
    """

    def __init__(self, strings: list[bytes], depth: int = SPAN):
        self.depth = depth
        lens = np.fromiter(map(len, strings), np.int32, len(strings))
        self.raw = b"\0".join([*strings, b""])
        self.text = np.frombuffer(self.raw, np.uint8).astype(np.int16) + np.int16(1)
        self.ends = np.cumsum(lens + 1, dtype=np.int32) - np.int32(1)
        self.text[self.ends] = 0
        self.starts = self.ends - lens
        self.n = len(self.text)
        self.end = np.repeat(self.ends, lens + 1)  # of each place's string
        self.keys, self.width = self._first_keys()
        order = self._sorted()
        before = self.text[order - 1]
        first = np.zeros(self.n, bool)
        first[self.starts] = True
        before[first[order]] = 0
        start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])).astype(np.int32)
        head = before[start]
        length = np.diff(np.append(start, self.n))
        by = np.argsort(head, kind="stable")  # runs by symbol, then by place
        head, self.run_start, length = head[by], start[by], length[by]
        # searching is the hot path: 32 bits where the keys fit
        self.key_type = np.int32 if 257 * self.n < 1 << 31 else np.int64
        self.run_key = head.astype(self.key_type) * self.key_type(self.n) + self.run_start
        total = np.cumsum(length) - length
        symbols = np.bincount(self.text, minlength=257)
        below = np.cumsum(symbols) - symbols
        base = np.append(total, 0)[np.searchsorted(head, np.arange(257))]
        self.run_rank = (total - base[head] + below[head]).astype(np.int32)  # rank in the first column at the run's start
        self.samples = np.append(start[1:], self.n).astype(np.int32) - np.int32(1)
        self.sample_at = order[self.samples]
        self.runs = len(start)
        ends = self.run_start + length.astype(np.int32) - np.int32(1)  # in the order of the symbols
        own = np.flatnonzero(head)  # before an end mark's run there is no suffix
        self.lane_at = order[ends[own]] - np.int32(1)
        self.lane_rank = self.run_rank[own] + (ends[own] - self.run_start[own])
        self.lane_length = self._shared(self.lane_at, order[np.minimum(self.lane_rank + 1, self.n - 1)])

    def _first_keys(self) -> tuple[np.ndarray, int]:
        """The first symbols of each suffix as a number, zero from the end mark on, and how many they are."""
        n = self.n
        if self.text.max(initial=0) < 256:  # so in UTF-8, which has no byte 255
            width, bits = 8, 8
            padded = np.concatenate([self.text.astype(np.uint8), np.zeros(width, np.uint8)])
            key = np.lib.stride_tricks.sliding_window_view(padded, width)[:n].copy().view(">u8").ravel().astype(np.uint64)
        else:
            width, bits = 7, 9
            padded = np.concatenate([self.text, np.zeros(width, np.int16)]).astype(np.uint64)
            key = np.zeros(n, np.uint64)
            for i in range(width):
                key = key << np.uint64(bits) | padded[i : i + n]
        for o in range(width):  # o symbols before an end mark
            at = self.ends[self.ends - o >= self.starts] - o
            keep = (1 << bits * width) - (1 << bits * (width - o))
            key[at] &= np.uint64(keep)
        return key, width

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share; nothing where they are the same place. End marks differ."""
        key, width = self.keys, self.width
        bits = 64 // width
        most = np.where(a == b, 0, np.minimum(self.end[a] - a, self.end[b] - b))
        out = np.zeros(len(a), np.int32)
        active, p, q = slice(None), a, b
        while len(p):
            x = key[p] ^ key[q]
            x &= ~(x >> np.uint64(1))  # the highest bit stays, and none behind it that a float would round up
            high = (x.astype(np.float64).view(np.int64) >> 52).astype(np.int32) - np.int32(1022)  # bits up to the highest
            out[active] += np.int32(width) - (np.maximum(high, 0) + np.int32(bits - 1)) // np.int32(bits)
            go = np.flatnonzero((x == 0) & (out[active] < most[active]))
            active = go if isinstance(active, slice) else active[go]
            p, q = a[active] + out[active], b[active] + out[active]
        return np.minimum(out, most)

    def _sorted(self) -> np.ndarray:
        """All suffixes in order, by doubling; only tied suffixes are sorted again."""
        n, end = self.n, self.end
        key, step = self.keys, self.width
        order = np.argsort(key).astype(np.int32)
        ranked = key[order]
        rank = np.empty(n, np.uint32)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])).astype(np.uint32)
        size = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, size)
        rank[self.ends] = np.arange(len(self.ends))
        order[: len(self.ends)] = self.ends
        tied = np.repeat(size > 1, size)
        tied[: len(self.ends)] = False
        place = np.flatnonzero(tied).astype(np.int32)  # places of the order that are not final
        while len(place):
            own = order[place]
            both = rank[own].astype(np.uint64) << np.uint64(32) | rank[np.minimum(own + np.int32(step), end[own])]
            again = np.argsort(both)
            own, both = own[again], both[again]
            order[place] = own
            at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            size = np.diff(np.append(at, len(own)))
            rank[own] = np.repeat(place[at], size)
            place = place[np.repeat(size > 1, size)]
            step *= 2
        return order

    def backward(self, rank: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Rank of the suffix that begins one symbol earlier (the symbol that precedes it is given)."""
        run = np.searchsorted(self.run_key, symbol.astype(self.key_type) * self.key_type(self.n) + rank, "right") - 1
        return self.run_rank[run] + (rank - self.run_start[run])

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the rank of its suffix and the bytes that it shares with the next one, streamed backwards.

        Every stretch before a sampled place is walked by one lane, all lanes at
        once; each step back adds a byte to the match.
        """
        rank, shared = np.empty(self.n, np.int32), np.zeros(self.n, np.int32)
        place = np.concatenate([self.ends, self.lane_at])
        at = np.concatenate([np.arange(len(self.ends), dtype=np.int32), self.lane_rank])
        length = np.concatenate([np.zeros(len(self.ends), np.int32), self.lane_length])
        rank[place], shared[place] = at, length
        by = np.argsort(place)
        left = np.empty(len(place), np.int64)
        left[by] = np.diff(place[by], prepend=-1) - 1  # unsampled places before each sampled one
        by = np.argsort(-left, kind="stable")
        by = by[: int((left > 0).sum())]
        place, at, length, left = place[by], at[by], length[by], left[by]
        step, active = 0, len(by)
        while active:
            place = place[:active] - np.int32(1)
            at = self.backward(at[:active], self.text[place])
            step += 1
            rank[place], shared[place] = at, length[:active] + np.int32(step)
            active = int(np.searchsorted(-left[:active], -step, "left"))
        return rank, shared

    def statistics(self) -> np.ndarray:
        """For each place the length of its longest match with any other place."""
        rank, shared = self.matches()
        ahead = np.empty(self.n, np.int32)
        ahead[rank] = shared
        return np.maximum(ahead, np.concatenate([[0], ahead[:-1]]))[rank]

    def intervals(self) -> np.ndarray:
        """For each place a number that is equal where places match over ``depth`` bytes or more, and only there."""
        rank, shared = self.matches()
        number = np.zeros(self.n, np.int32)
        inner = rank < self.n - 1
        number[rank[inner] + 1] = shared[inner] < self.depth
        return np.cumsum(number, dtype=np.int32)[rank]


def _segments(texts: list[bytes], most: int = 1 << 20):
    """(text number, offset, bytes): long texts in segments that overlap by a window less one byte."""
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - SPAN + 1, 1), most):
            yield i, a, t[a : a + most + SPAN - 1]


class Passages:
    """Anchors of a block, in document order: hash, row, first byte in the row, passage bytes, place of the anchor in them."""

    def __init__(self, texts: list[bytes]):
        hashes, rows, firsts, lens, starts, raws, grams = [], [], [], [], [], [], []
        group: list[tuple[int, int, bytes]] = []
        held = base = 0

        def close():
            nonlocal base
            raw = b"".join(s[2] for s in group)
            h, first, n, gram = _anchors(raw, np.array([len(s[2]) for s in group], np.int64))
            edges = np.cumsum([0] + [len(s[2]) for s in group])
            seg = np.searchsorted(edges, first, "right") - 1
            hashes.append(h)
            rows.append(np.array([s[0] for s in group], np.int64)[seg])
            firsts.append(first - edges[seg] + np.array([s[1] for s in group], np.int64)[seg])
            lens.append(n)
            grams.append(gram)
            starts.append(first + base)
            raws.append(raw)
            base += len(raw)

        for s in _segments(texts):
            if group and held + len(s[2]) > 1 << 17:
                close()
                group, held = [], 0
            group.append(s)
            held += len(s[2])
        if group:
            close()
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.hash, self.row, self.first = cat(hashes, np.uint64), cat(rows, np.int64), cat(firsts, np.int64)
        self.len, self.at, self.raw = cat(lens, np.int64), cat(starts, np.int64), b"".join(raws)
        self.gram = cat(grams, np.int64)

    def keys(self):
        """Distinct hashes, sorted, and for each anchor the number of its hash."""
        order = np.argsort(self.hash)
        ranked = self.hash[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return ranked[new], place

    def sent(self, use: np.ndarray, hot: np.ndarray):
        """What the anchors in ``use`` send: hash, place in the bytes, length, row, first byte in the row.

        A passage; or, where ``hot``, its runs of windows that start at equal distances
        from the anchor, each under the hash of the bytes that all its windows hold.
        """
        cold = use[~hot]
        out = [[self.hash[cold], self.at[cold], self.len[cold], self.row[cold], self.first[cold]]]
        own = use[hot]
        for j in range(-(-(SPAN - GRAM + 1) // RUN)) if len(own) else ():
            start = self.gram[own] - (SPAN - GRAM) + RUN * j
            low, high = np.maximum(start, 0), np.minimum(start + RUN - 1, self.len[own] - SPAN)
            k = np.flatnonzero(low <= high)
            some, low, high = own[k], low[k], high[k]
            # RUN windows of SPAN bytes share SPAN - RUN + 1 of them
            shared = self.at[some] + start[k] + RUN - 1
            held = np.frombuffer(self.raw, np.uint8)[shared[:, None] + np.arange(SPAN - RUN + 1)]
            mixed = (_VALUES[held] * K.powers(_BASE, SPAN - RUN + 1)).sum(1, dtype=np.uint64)
            out.append([K.mix(K.mix(mixed) + self.hash[some] * _AGAIN + np.uint64(j)), self.at[some] + low, high - low + SPAN, self.row[some], self.first[some] + low])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def distinct(self, sent, docs: np.ndarray, bits: int):
        """Of what is ``sent``: for each range its distinct passages and their smallest doc, and for each one (range, number)."""
        hashes, at, size, rows, _ = sent
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        by: dict[int, dict[bytes, int]] = {}
        low: dict[int, list[int]] = {}
        number = np.empty(len(at), np.int64)
        raw = self.raw
        for k, (p, a, n, d) in enumerate(zip(part.tolist(), at.tolist(), size.tolist(), docs[rows].tolist(), strict=True)):
            own = by.get(p)
            if own is None:
                own, low[p] = by.setdefault(p, {}), []
            c = raw[a : a + n]
            i = own.setdefault(c, len(own))
            number[k] = i
            if i == len(low[p]):
                low[p].append(d)
            elif d < low[p][i]:
                low[p][i] = d
        return by, low, part, number


def _anchors(raw: bytes, lens: np.ndarray):
    """Hash, first byte and length of the passage, and place of the anchor in it, of each anchor of segments that stand one after another."""
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) < SPAN:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h, width = _VALUES[buf], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h = K.mix(h)
    low = K.sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), SPAN - GRAM + 1)
    anchor = (low & _PLACE).astype(np.int64)
    ends = np.cumsum(lens)
    valid = np.zeros(len(anchor) + 1, np.int32)
    has = lens >= SPAN
    np.add.at(valid, ends[has] - lens[has], 1)
    np.add.at(valid, ends[has] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    own = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    first = at[new]
    last = at[np.append(new[1:], len(at)) - 1] if len(at) else first
    # the chosen hashes are small ones; mixed again they spread over all ranges
    return K.mix(h[own[new]] ^ _AGAIN), first, last - first + SPAN, own[new] - first


def _docs(ids) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _send_anchors(bits: int):
    def emit(ids, texts):
        own, docs = Passages(texts), _docs(ids)
        if not len(own.hash):
            return
        keys, place = own.keys()
        by = np.argsort(place, kind="stable")
        first = np.searchsorted(place[by], np.arange(len(keys)))
        d = docs[own.row][by]
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        times = np.minimum(np.diff(np.append(first, len(by))), 65_535).astype(np.uint16)
        for part, s in B.parts_of(keys, bits):
            k = keys[s]
            vals = np.packbits(several[s]).tobytes() + times[s].tobytes()
            yield part, len(k), B.planes(np.diff(k, prepend=k[:1] * 0)), B.squeeze(vals), B.checksum(k)

    return emit


def _rule_out(most: int):
    """For each anchor of each piece: whether documents may share it, and whether it occurs more than ``most`` times."""

    def reduce(rows):
        keys = np.concatenate([np.cumsum(B.unplanes(r["keys"], np.uint64), dtype=np.uint64) for r in rows])
        several, times = [], []
        for r in rows:
            raw, n = B.unsqueeze(r["vals"]), r["n"]
            several.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8)), count=n))
            times.append(np.frombuffer(raw, np.uint16, n, -(-n // 8)))
        order = np.argsort(keys)
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        repeated = (size > 1) | (np.maximum.reduceat(np.concatenate(several)[order], first) > 0)
        hot = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), first) > most
        back = np.empty((2, len(keys)), bool)
        back[0, order], back[1, order] = np.repeat(repeated, size), np.repeat(hot, size)
        at = 0
        for r in rows:
            yield r["block"], 0, B.squeeze(np.int32(r["n"]).tobytes() + np.packbits(back[:, at : at + r["n"]], axis=1).tobytes())
            at += r["n"]

    return reduce


def _repeated(own: Passages, given, bits: int):
    """What the anchors that other documents may hold too send (see ``Passages.sent``)."""
    keys, place = own.keys()
    B.same_reading(keys, bits, given[-1])
    flags = []
    for p in sorted(given.get(0, {})):
        raw = B.unsqueeze(given[0][p])
        flags.append(np.unpackbits(np.frombuffer(raw[4:], np.uint8).reshape(2, -1), axis=1, count=int(np.frombuffer(raw[:4], np.int32)[0])))
    mask, hot = np.concatenate(flags, axis=1).astype(bool) if flags else np.zeros((2, 0), bool)
    use = np.flatnonzero(mask[place])
    return own.sent(use, hot[place][use])


#: Bits of the finer ranges inside a range: an index each, small enough for a core's cache.
FINE = 3


def _send_passages(bits: int, anchor_bits: int):
    def work(ids, texts, given):
        own = Passages(texts)
        by, low, _, _ = own.distinct(_repeated(own, given, anchor_bits), _docs(ids), bits + FINE)
        rows = []
        for part in sorted({p >> FINE for p in by}):
            fine = range(part << FINE, part + 1 << FINE)
            counts = np.array([len(by.get(p, ())) for p in fine], np.uint32)
            lens = np.fromiter((len(x) for p in fine for x in by.get(p, ())), np.uint8, int(counts.sum()))
            data = b"".join(x for p in fine for x in by.get(p, ()))
            docs = np.array([d for p in fine for d in low.get(p, ())], np.int64)
            rows.append(dict(part=part, n=len(lens), keys=B.squeeze(counts.tobytes() + lens.tobytes() + data), vals=B.planes(docs), sum=0))
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("sum", pa.int64())]))

    return work


def _index(rows):
    """For each piece's passages, runs of windows with one smallest document: runs, lengths, documents."""
    pieces = []
    for r in rows:
        raw, n = B.unsqueeze(r["keys"]), r["n"]
        head = 4 << FINE
        counts = np.frombuffer(raw, np.uint32, 1 << FINE).tolist()
        ends = (np.cumsum(np.frombuffer(raw, np.uint8, n, head), dtype=np.int64) + head + n).tolist()
        starts = [head + n, *ends[:-1]]
        pieces.append((raw, counts, starts, ends, B.unplanes(r["vals"], np.int64).tolist()))
    done: list[list] = [[] for _ in rows]
    at = [0] * len(rows)
    for fine in range(1 << FINE):
        number: dict[bytes, int] = {}
        low: list[int] = []
        mine = []
        for k, (raw, counts, starts, ends, docs) in enumerate(pieces):
            a = at[k]
            at[k] = b = a + counts[fine]
            own = []
            for x, y, d in zip(starts[a:b], ends[a:b], docs[a:b], strict=True):
                i = number.setdefault(raw[x:y], len(low))
                if i == len(low):
                    low.append(d)
                elif d < low[i]:
                    low[i] = d
                own.append(i)
            mine.append(np.array(own, np.int64))
        if low:
            runs, start, length, value = _least(RunLengthIndex(list(number)), np.array(low, np.int64))
            for k, own in enumerate(mine):
                take = np.repeat(start[own] - (np.cumsum(runs[own]) - runs[own]), runs[own]) + np.arange(int(runs[own].sum()))
                done[k].append((runs[own].astype(np.uint8), length[take].astype(np.uint8), value[take]))
    for r, parts in zip(rows, done, strict=True):
        yield r["block"], 1, B.squeeze(np.concatenate([p[0] for p in parts]))
        yield r["block"], 2, B.squeeze(np.concatenate([p[1] for p in parts]))
        yield r["block"], 3, B.planes(np.concatenate([p[2] for p in parts]))


def _least(index: RunLengthIndex, docs: np.ndarray):
    """Runs of windows of each string that have one smallest document: runs of a string, its first run, lengths, documents."""
    interval = index.intervals()
    string = np.repeat(np.arange(len(docs), dtype=np.int32), index.ends - index.starts + 1)
    window = np.flatnonzero(np.arange(index.n, dtype=np.int32) + np.int32(SPAN) <= index.end)
    owner, interval = string[window], interval[window]
    least = np.full(int(interval.max()) + 1, LAST)
    np.minimum.at(least, interval, docs[owner])
    value = least[interval]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    length = np.diff(np.append(new, len(value)))
    runs = np.bincount(owner[new], minlength=len(docs))
    return runs, np.cumsum(runs) - runs, length, value[new]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mark(bits: int, anchor_bits: int, keep_text: bool):
    def work(ids, texts, given):
        own, docs = Passages(texts), _docs(ids)
        sent = _repeated(own, given, anchor_bits)
        rows, firsts = sent[3:]
        by, _, part, number = own.distinct(sent, docs, bits + FINE)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(lens) - lens
        edge = np.zeros(int(lens.sum()) + 1, np.int32)
        before = dict.fromkeys(by, 0)  # passages of finer ranges that stand before in the piece
        for p in by:
            before[p] = sum(len(by[q]) for q in range(p >> FINE << FINE, p) if q in by)
        number += np.array([before[p] for p in part.tolist()], np.int64)
        part >>= FINE
        by_part = np.argsort(part, kind="stable")
        for k in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(part) else ():
            p = int(part[k[0]])
            runs = np.frombuffer(B.unsqueeze(given[1][p]), np.uint8).astype(np.int64)
            size = np.frombuffer(B.unsqueeze(given[2][p]), np.uint8).astype(np.int64)
            value = B.unplanes(given[3][p], np.int64)
            start = np.cumsum(runs) - runs
            offset = np.cumsum(size) - size
            i = number[k]
            take = np.repeat(start[i] - (np.cumsum(runs[i]) - runs[i]), runs[i]) + np.arange(int(runs[i].sum()))
            row = np.repeat(rows[k], runs[i])
            first = np.repeat(base[rows[k]] + firsts[k] - offset[start[i]], runs[i]) + offset[take]
            hit = value[take] < docs[row]
            np.add.at(edge, first[hit], 1)
            np.add.at(edge, first[hit] + size[take][hit] - 1 + SPAN, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_removed, n_spans, kept = [], [], []
        for t, a, n in zip(texts, base.tolist(), lens.tolist(), strict=True):
            g = gone[a : a + n]
            if not g.any():
                n_removed.append(0), n_spans.append(0), kept.append(t)
                continue
            n_removed.append(int(g.sum()))
            n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes())
        cols = dict(doc_id=pa.array(ids, pa.int64()), n_bytes=lens, n_removed=n_removed, n_spans=n_spans, kept_sha256=[hashlib.sha256(x).hexdigest() for x in kept])
        if keep_text:
            cols["kept"] = pa.array(kept, pa.binary())
        names = list(cols)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(cols.values(), types, strict=False)], names)

    return work


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """RESULT and, with ``keep_text``, the remaining bytes (``kept``); one row for each document row."""
    ship(docs.sparkSession)
    packed, tasks, anchor_bits = B.pack(docs, id_col, text_col), B.tasks(docs), B.ranges(docs)
    ruled = stored(B.answers(B.pieces(docs, id_col, text_col, _send_anchors(anchor_bits)), _rule_out(hot), tasks), "anchors", "uncompressed")
    # an index takes some hundred bytes for each byte of its passages, so its ranges are smaller
    bits = B.ranges(docs, 16)

    held = packed.repartition(tasks, "block")
    passages = held.groupBy("block").cogroup(ruled.repartition(tasks, "block").groupBy("block"))
    send = _send_passages(bits, anchor_bits)

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        got = send(*B.unpack(row), B.by_kind(given))
        got = got.add_column(1, "block", pa.array([row["block"]] * len(got), pa.int64()))
        B.trim()
        return got

    found = B.answers(passages.applyInArrow(run, B.PIECE), _index, tasks)
    schema = RESULT + (", kept binary" if keep_text else "")
    return B.together(packed, ruled.unionByName(found), _mark(bits, anchor_bits, keep_text), schema, tasks)


def op1(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
