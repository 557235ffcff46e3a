"""Quality classifier: a factorisation machine over hashed words and structure.

Features of a whole text: the share of each hashed lower-case word (2**14
buckets), and structure statistics (length, word length, shares of
capitals, digits, marks, white space, distinct words and distinct lines), each
standardised. The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2],

so pairwise interactions cost time linear in the text.

Learning takes at most ``MOST_ROWS`` labelled rows (12,000), those of smallest hash of
their id (a documented bound; every row is eligible alike), by AdaGrad on the
driver with a fixed seed and order. Scoring is one scan without a shuffle, the
model a closure of fixed size. Null and empty texts have structure features
only, and get a score. Labels null or other than 0 and 1 teach nothing; without
both classes the score is the share of ones. Metadata of a row (source, language, ids)
are never features; what is known of a text besides its words is its structure. Texts
of any length are taken whole. Equal texts get equal scores; a doc_id with several
texts or labels teaches each pair of them, in a fixed order. An empty table gives no
rows and teaches nothing. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .langid import held_out
from .runtime import attach, ship

BUCKETS, RANK, MOST_ROWS, EPOCHS, STEP, DECAY = 1 << 14, 8, 12_000, 6, 0.05, 1e-5
STATS = 12


def features(texts: list[bytes]):
    """For a batch: (text number, bucket, share) of its hashed words, and structure statistics."""
    w = K.Words(texts, K.BY_SPACE)
    h = w.hashes()
    owner = w.owner().astype(np.uint64)
    full, repeats = np.unique(owner << np.uint64(40) | h >> np.uint64(24), return_counts=True)
    distinct = np.bincount((full >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    key, n = np.unique(owner * np.uint64(BUCKETS) + (h & np.uint64(BUCKETS - 1)), return_counts=True)
    rows, cols = (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)
    words = np.maximum(w.n, 1)
    stats = np.zeros((len(texts), STATS), np.float64)
    letters = (w.end - w.start).astype(np.float64)
    per = lambda x: np.bincount(w.owner(), x, len(texts))
    last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58] = 1, 2, 3
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
    kinds[[10, 13]] = 5
    kinds[[32, 9, 11, 12]] = 6
    kinds[128:] = 7
    kind = kinds[w.buf]
    size = np.array([len(t) for t in texts], np.float64)
    for i, t in enumerate(texts):
        a = w.text_start[i]
        c = np.bincount(kind[a : a + len(t)], minlength=8)
        lines = t.split(b"\n")
        many = max(len(t), 1)
        stats[i, :7] = np.log1p(len(t)), c[1] / many, c[3] / many, c[4] / many, c[5] / many, len(set(lines)) / len(lines), c[7] / many
    stats[:, 7] = per(letters) / words
    stats[:, 8] = distinct / words
    stats[:, 9] = per((kinds[last] == 4).astype(float)) / words
    stats[:, 10] = np.log1p(w.n)
    stats[:, 11] = size / (w.n + 1.0)
    return rows, cols, n / words[rows], stats


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def margin(self, rows, cols, x, stats):
        """Margins and, for learning, the sums of each row's factors."""
        z = np.clip((stats - self.mean) / self.sd, -5, 5)
        n = len(stats)
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        lin = z @ ws + np.bincount(rows, self.w[cols] * x, n)
        s = z @ vs
        q = (z * z) @ (vs * vs)
        for f in range(self.v.shape[1]):
            p = self.v[cols, f] * x
            s[:, f] += np.bincount(rows, p, n)
            q[:, f] += np.bincount(rows, p * p, n)
        return self.w0 + lin + 0.5 * (s * s - q).sum(1), s, z

    def score(self, texts: list[bytes]) -> np.ndarray:
        m = self.margin(*features(texts))[0]
        return 1.0 / (1.0 + np.exp(-np.clip(m, -40, 40)))


def _rows(texts: list[bytes]):
    """For each text its buckets (uint16), shares (float32) and structure statistics."""
    for a, b in K.batches(texts):
        rows, cols, x, stats = features(texts[a:b])
        at = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            s = slice(at[i], at[i + 1])
            yield cols[s].astype(np.uint16), x[s].astype(np.float32), stats[i]


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn from rows of ``_rows`` by AdaGrad over shuffled mini-batches of 64."""
    y = np.asarray(labels, np.float64)
    rate = float(y.mean()) if len(y) else 0.5
    odds = float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / np.clip(1 - rate, 1e-6, 1)))
    rng = np.random.default_rng(seed)
    m = Model(odds, np.zeros(BUCKETS + STATS), np.zeros((BUCKETS + STATS, RANK)), np.zeros(STATS), np.ones(STATS))
    if len(set(y.tolist())) < 2:
        return m
    stats = np.stack([r[2] for r in rows])
    m.v = rng.normal(0, 0.05, m.v.shape)
    m.mean, m.sd = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    gw, gv, g0 = np.full(m.w.shape, 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for b in range(0, len(y), 64):
            own = order[b : b + 64]
            c = np.concatenate([rows[i][0] for i in own]).astype(np.int64)
            v = np.concatenate([rows[i][1] for i in own]).astype(np.float64)
            r = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            margin, s, z = m.margin(r, c, v, stats[own])
            e = (1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))) - y[own]) / len(own)
            ids, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, e[r] * v, len(ids)) + DECAY * m.w[ids]
            dv = np.empty((len(ids), RANK))
            for f in range(RANK):
                dv[:, f] = np.bincount(back, e[r] * v * (s[r, f] - m.v[c, f] * v), len(ids))
            dv += DECAY * m.v[ids]
            ids = np.concatenate([ids, np.arange(BUCKETS, BUCKETS + STATS)])
            vs = m.v[BUCKETS:]
            dw = np.concatenate([dw, e @ z])
            dv = np.concatenate([dv, (e[:, None] * z).T @ s - vs * (e @ (z * z))[:, None]])
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            g0 += e.sum() ** 2
            m.w[ids] -= STEP * dw / np.sqrt(gw[ids])
            m.v[ids] -= STEP * dv / np.sqrt(gv[ids])
            m.w0 -= STEP * e.sum() / np.sqrt(g0)
    return m


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Learn from the labelled rows of ``docs``, at most ``most_rows`` of them; the driver gets their features, not their texts."""
    ship(docs.sparkSession)
    q = lambda c: F.col(f"`{c}`")
    y = labels.select(q(id_col).alias("id"), q(label_col).alias("y")).where("y in (0, 1)")
    d = docs.select(q(id_col).alias("id"), q(text_col).alias("text"))
    ids = d.select("id", F.xxhash64("id").alias("h")).join(y, "id").orderBy("h", "id", "y").limit(most_rows)

    def fn(cols):
        got = list(_rows(K.utf8(cols["text"])))
        return {n: [g[i].tobytes() for g in got] for i, n in enumerate(("cols", "shares", "stats"))}

    rows = attach(d.join(F.broadcast(ids), "id"), ["text"], ["h", "id", "y"], fn, "cols binary, shares binary, stats binary")
    got = rows.select("c.*", "r.*").toPandas().sort_values(["h", "id", "y", "cols"], kind="stable")
    parts = [(np.frombuffer(c, np.uint16), np.frombuffer(x, np.float32), np.frombuffer(z, np.float64)) for c, x, z in zip(got["cols"], got["shares"], got["stats"], strict=True)]
    return fit(parts, got["y"].to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``c`` (carried) and ``r`` (score, predicted), one row for each document row."""
    ship(docs.sparkSession)

    def fn(cols):
        texts = K.utf8(cols[text_col])
        s = np.concatenate([model.score(texts[a:b]) for a, b in K.batches(texts)])
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return attach(docs, [text_col], list(carry or ["doc_id"]), fn, "score double, predicted int")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out("doc_id", 3, 1)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("c.doc_id", held_out("c.doc_id", 3, 1).alias("held_out"), "r.score", "r.predicted")
