"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform share.

Tokens: runs of anything but ASCII white space, letters A-Z lower-cased, then
one end token for each document. With c the counts in the training documents,

    p(w | u) = l2(b) c(u w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1),

where b is the power of two of the context's count c(u) (b = 0: u is unseen).
The weights of each bucket b are learned by expectation-maximisation on deleted
counts: each training bigram is held out once, so its own counts are less by
one. The events enter EM as sums over cells of (b, half octaves of both estimates):
their number and the sum of each estimate, so a cell stands for its events by their
means. The number of cells is fixed, whatever the input.

Counts cover all training documents. Words and bigrams are keyed by 64-bit
hashes. Each block of documents sends its distinct keys once and gets counts
back (module ``blocks``), so hot words cost no more than rare ones. The counts
are stored once in the shared scratch folder and used by both passes.

Null and empty texts have the end token only. Without training documents only
the uniform share is left. A text of any length is taken whole and is a block of its
own if it is longer than one. Rows that repeat a doc_id train and are scored each by
their own text; a null doc_id trains. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textkernels as K
from .runtime import ship, stored

BUCKETS, STEPS = 48, 96
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_A, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def trains(doc_id, n: int, rest: int) -> bool:
    """A document trains unless crc32 of its id as text leaves ``rest`` modulo ``n``."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % n != rest


def tokens(texts: list[bytes]):
    """Token hashes of the texts, each with its end token, and the number of tokens of each text."""
    out, sizes = [], []
    for a, b in K.batches(texts):
        w = K.Words(texts[a:b], K.BY_SPACE)
        n = w.n + 1
        t = np.empty(int(n.sum()), np.uint64)
        last = np.cumsum(n) - 1
        inner = np.ones(len(t), bool)
        inner[last] = False
        t[inner], t[last] = w.hashes(), END
        out.append(t)
        sizes.append(n)
    cat = lambda x, k: np.concatenate(x) if x else np.zeros(0, k)
    return cat(out, np.uint64), cat(sizes, np.int64)


def keys_of(t: np.ndarray, sizes: np.ndarray):
    """Unigram keys (odd) and bigram keys (even) of the tokens, and where texts start."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    prev = np.empty_like(t)
    prev[1:] = t[:-1]
    prev[first] = START
    one = K.mix(t * _A) | np.uint64(1)
    two = K.mix(K.mix(prev ^ _C) * _A + t) & ~np.uint64(1)
    return one, two, first


class Local:
    """The distinct keys of a block, sorted, and the place of each token's keys among them."""

    def __init__(self, texts: list[bytes]):
        t, self.sizes = tokens(texts)
        one, two, self.first = keys_of(t, self.sizes)
        self.n = len(t)
        both = np.concatenate([one, two])
        order = np.argsort(both)
        ranked = both[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        self.keys = ranked[new]
        at = np.empty(len(both), np.int64)
        at[order] = np.cumsum(new) - 1
        self.one, self.two = at[: self.n], at[self.n :]

    def mask(self, rows: np.ndarray) -> np.ndarray:
        return np.repeat(rows, self.sizes)


def _emit(n: int, rest: int, bits: int):
    def emit(ids, texts):
        own = Local(texts)
        use = own.mask(np.array([trains(i, n, rest) for i in ids], bool))
        count = np.bincount(own.one[use], minlength=len(own.keys)) + np.bincount(own.two[use], minlength=len(own.keys))
        for part, s in B.parts_of(own.keys, bits):
            k = own.keys[s]
            yield part, len(k), B.planes(np.diff(k, prepend=k[:1] * 0)), B.planes(count[s].astype(np.uint32)), B.checksum(k)

    return emit


def _reduce(rows):
    """Totals for every key of every piece; block -1: N and V of this range."""
    keys = np.concatenate([np.cumsum(B.unplanes(r["keys"], np.uint64), dtype=np.uint64) for r in rows])
    count = np.concatenate([B.unplanes(r["vals"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.add.reduceat(count[order], first)
    words = (ranked[first] & np.uint64(1)).astype(bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
    at = 0
    for r in rows:
        yield r["block"], 0, B.planes(back[at : at + r["n"]])
        at += r["n"]
    yield -1, 0, np.array([total[words].sum(), (total[words] > 0).sum()], np.int64).tobytes()


def _counts(texts, given, bits: int):
    """The block's keys, and c(u), c(w), c(u w) of each token; c(u) of a first word is None's place holder -1."""
    own = Local(texts)
    B.same_reading(own.keys, bits, given[-1])
    got = [B.unplanes(given[0][p], np.int64) for p in sorted(given.get(0, {}))]
    total = np.concatenate(got) if got else np.zeros(0, np.int64)
    cw, cuw = total[own.one], total[own.two]
    cu = np.empty_like(cw)
    cu[1:] = cw[:-1]
    cu[own.first] = -1
    return own, cu, cw, cuw


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def _step(p: np.ndarray) -> np.ndarray:
    """Half octaves below 1, from 1; 0 for an estimate of 0."""
    return np.where(p > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(p, 1e-300))).astype(np.int64) + 1, STEPS - 1), 0)


def em(cells: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) for each bucket, from rows (bucket, mean p2, mean p1, events)."""
    lam = np.tile([0.4, 0.55, 0.05], (BUCKETS, 1))
    lam[0] = [0.0, 0.9, 0.1]
    if len(cells):
        b, n = cells[:, 0].astype(np.int64), cells[:, 3]
        p = np.stack([cells[:, 1], cells[:, 2], np.full(len(b), 1.0 / (vocabulary + 1))], 1)
        for _ in range(rounds):
            share = lam[b] * p
            share *= (n / share.sum(1))[:, None]
            new = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1)
            seen = new.sum(1) > 0
            lam[seen] = new[seen] / new[seen].sum(1, keepdims=True)
            lam[:, 2] = np.maximum(lam[:, 2], 1e-6)
            lam /= lam.sum(1, keepdims=True)
    return lam


class Model:
    """Counts joined to the blocks of ``docs``, and learned weights."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2):
        ship(docs.sparkSession)
        self.folds, self.held_fold = folds, held_fold
        q = F.col(f"`{id_col}`").cast("string")
        self.starts = docs.where(F.coalesce(F.crc32(q) % folds != held_fold, F.lit(True))).count()
        self.packed = B.pack(docs, id_col, text_col)
        self.bits, self.tasks = B.ranges(docs), B.tasks(docs)
        sent = B.pieces(docs, id_col, text_col, _emit(folds, held_fold, self.bits))
        self.totals = stored(B.answers(sent, _reduce, self.tasks), "ngrams", "uncompressed")
        sums = [np.frombuffer(r.vals, np.int64) for r in self.totals.where("block < 0").select("vals").toLocalIterator()]
        self.n, self.v = (int(x) for x in np.sum(sums, 0)) if sums else (0, 0)
        self.weights = em(self._histogram(), self.v)

    def _histogram(self) -> np.ndarray:
        n, starts, folds, held_fold, bits = self.n, self.starts, self.folds, self.held_fold, self.bits

        def work(ids, texts, given):
            own, cu, cw, cuw = _counts(texts, given, bits)
            use = own.mask(np.array([trains(i, folds, held_fold) for i in ids], bool))
            cu = np.where(cu < 0, starts, cu)[use] - 1
            p2 = np.where(cu > 0, (cuw[use] - 1) / np.maximum(cu, 1), 0.0)
            p1 = (cw[use] - 1) / max(n - 1, 1)
            cell = (_bucket(cu) * STEPS + _step(p2)) * STEPS + _step(p1)
            cells, at = np.unique(cell, return_inverse=True)
            sums = [np.bincount(at, x, len(cells)) for x in (None, p2, p1)]
            return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(sums[0], pa.int64()), "p2": sums[1].astype(float), "p1": sums[2].astype(float)})

        # at most BUCKETS x STEPS x STEPS rows reach the driver, whatever the input
        rows = B.together(self.packed, self.totals, work, "cell long, n long, p2 double, p1 double", self.tasks)
        rows = rows.groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("n", "p2", "p1")]).collect()
        return np.array([[r.cell // STEPS // STEPS, r.p2 / r.n, r.p1 / r.n, r.n] for r in sorted(rows, key=lambda r: r.cell)], float).reshape(-1, 4)

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each document row."""
        n, v, lam, starts, folds, held_fold, bits = self.n, self.v, self.weights, self.starts, self.folds, self.held_fold, self.bits

        def work(ids, texts, given):
            own, cu, cw, cuw = _counts(texts, given, bits)
            cu = np.where(cu < 0, starts, cu)
            b = _bucket(cu)
            p = lam[b, 0] * cuw / np.maximum(cu, 1) + lam[b, 1] * cw / max(n, 1) + lam[b, 2] / (v + 1)
            per = lambda x: np.add.reduceat(x, own.first)
            base = np.log10(cw + 1.0) - math.log10(n + v + 1)
            cols = dict(doc_id=pa.array(ids, pa.int64()), held_out=[i is not None and not trains(i, folds, held_fold) for i in ids], n_tokens=own.sizes, n_known=per((cw > 0).astype(np.int64)), train_tokens=np.full(len(ids), n), base_score=per(base), score=per(np.log10(p)))
            return pa.table(cols)

        return B.together(self.packed, self.totals, work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", self.tasks)


def op7(spark, sf_dir: str) -> DataFrame:
    return Model(spark.read.parquet(f"{sf_dir}/documents.parquet")).score()
