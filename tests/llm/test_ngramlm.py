import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngramlm as L

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def toks(t):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())
    return [*WORD.findall(b), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(docs, lam):
    uni, bi, starts = Counter(), Counter(), 0
    for i, t in docs:
        if not held(i):
            w = toks(t)
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w, strict=True))
            starts += 1
    n, v, out = sum(uni.values()), len(uni), []
    for i, t in docs:
        w = toks(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip(["<s>", *w[:-1]], w, strict=True):
            c = starts if u == "<s>" else uni[u]
            b = int(math.log2(c)) + 1 if c else 0
            score += math.log10(lam[b, 0] * bi[u, x] / max(c, 1) + lam[b, 1] * uni[x] / max(n, 1) + lam[b, 2] / (v + 1))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def compare(got, want):
    got, want = sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_matches_brute_force_on_a_whole_table(spark):
    m = L.Model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compare([tuple(r) for r in m.score().collect()], brute(docs, m.weights))
    rows = [r for r in m.score().collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)  # better than the base on held-out texts


def test_odd_rows(spark, odd_docs, write_sf):
    sf = write_sf(documents=odd_docs)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    m = L.Model(spark.read.parquet(f"{sf}/documents.parquet"))
    compare([tuple(r) for r in m.score().collect()], brute(docs, m.weights))


def test_empty_table_and_no_training_rows(spark, write_sf, odd_docs):
    assert L.Model(odd_docs.limit(0)).score().count() == 0
    ids = [i for i in range(100) if held(i)][:3]
    sf = write_sf(documents=spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"))
    got = L.op7(spark, sf).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in got)


def test_em_finds_the_weights_that_made_the_events():
    r = np.random.default_rng(0)
    true, cells = np.array([0.7, 0.25, 0.05]), Counter()
    for _ in range(40_000):
        k = r.choice(3, p=true)
        # an event is likelier under the source that made it
        p2, p1 = (0.5, 2**-10) if k == 0 else (0.0, 0.25) if k == 1 else (0.0, 0.0)
        cells[5, p2, p1] += 1
    rows = np.array([[*c, n] for c, n in cells.items()], float)
    lam = L.em(rows, 1000)[5]
    assert abs(lam[0] - 0.7) < 0.02 and abs(lam[1] - 0.25) < 0.02


def test_weights_are_those_of_em_over_single_events(spark):
    """EM by definition: every training bigram is an event, without its own count."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if not held(r.doc_id)]
    uni, bi = Counter(), Counter()
    for _, t in docs:
        w = toks(t)
        uni.update(w), bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v, events = sum(uni.values()), len(uni), []
    for (u, w), c in bi.items():
        cu = (len(docs) if u == "<s>" else uni[u]) - 1
        events.append((int(math.log2(cu)) + 1 if cu else 0, (c - 1) / cu if cu else 0.0, (uni[w] - 1) / (n - 1), 1 / (v + 1), c))
    e = np.array(events)
    lam = np.tile([0.4, 0.55, 0.05], (L.BUCKETS, 1))
    lam[0] = [0.0, 0.9, 0.1]
    b, p, many = e[:, 0].astype(int), e[:, 1:4], e[:, 4]
    for _ in range(60):
        share = lam[b] * p
        share *= (many / share.sum(1))[:, None]
        new = np.stack([np.bincount(b, share[:, k], L.BUCKETS) for k in range(3)], 1)
        seen = new.sum(1) > 0
        lam[seen] = new[seen] / new[seen].sum(1, keepdims=True)
        lam[:, 2] = np.maximum(lam[:, 2], 1e-6)
        lam /= lam.sum(1, keepdims=True)
    got = L.Model(spark.read.parquet(f"{sf}/documents.parquet")).weights
    often = np.bincount(b, many, L.BUCKETS) > 100
    assert often.sum() > 5 and np.abs(got[often] - lam[often]).max() < 0.01


def test_rows_that_repeat_an_id_with_other_texts(spark):
    docs = [(1, "a b c"), (1, "c b"), (2, "a b"), (None, "a b c"), (None, None)]
    m = L.Model(spark.createDataFrame(docs, "doc_id long, text string"))
    compare([tuple(r) for r in m.score().collect()], brute(docs, m.weights))
