import hashlib
import random

import numpy as np

from tessera.llm import runindex as R


def brute(docs, span=50):
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        d = R.LAST if i is None else i
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            least[w] = min(least.get(w, d), d)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        d = R.LAST if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - span + 1):
            if least[b[s : s + span]] < d:
                gone[s : s + span] = True
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed, n=60):
    r = random.Random(seed)
    line = lambda k: "".join(r.choice("ab é") for _ in range(k))
    shared = [line(r.choice([30, 48, 49, 50, 51, 70, 200, 900])) for _ in range(8)]
    docs = []
    for i in range(n):
        t = "".join(r.choice([line(r.randint(0, 60)), r.choice(shared), "x" * r.choice([10, 49, 120])]) for _ in range(r.randint(0, 6)))
        docs.append((r.randrange(10_000), t))
    docs += [(5, docs[3][1]), (docs[4][0], docs[4][1]), (docs[4][0], docs[7][1]), (9, None), (8, ""), (None, docs[2][1])]
    return docs


def test_index_orders_suffixes_and_walks_backwards():
    r = random.Random(3)
    for _ in range(60):
        strings = list({bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))})
        x = R.RunLengthIndex(strings, depth=4)
        order = x._sorted()
        sym = [(tuple(x.text[p : next(e for e in x.ends if e >= p)]), int(next(k for k, e in enumerate(x.ends) if e >= p))) for p in order]
        assert sym == sorted(sym)
        rank = np.empty(x.n, np.int64)
        rank[order] = np.arange(x.n)
        inner = np.array([p for p in range(1, x.n) if p not in set(x.starts.tolist())], np.int64)
        assert (x.backward(rank[inner], x.text[inner - 1].astype(np.int64)) == rank[inner - 1]).all()
        got = x.intervals()
        windows = {}
        for k, s in enumerate(strings):
            for a in range(len(s) - 3):
                windows.setdefault(s[a : a + 4], set()).add(int(got[x.starts[k] + a]))
        assert all(len(v) == 1 for v in windows.values())
        assert len({next(iter(v)) for v in windows.values()}) == len(windows)
        assert x.runs <= x.n and (order[x.samples] == x.sample_at).all()


def test_streamed_lengths_are_those_of_plain_comparison():
    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    r = random.Random(5)
    for letters, longest in ((b"ab", 30), (b"ab\x00\xff", 12), (b"a", 40), (bytes(range(256)), 20)):
        for _ in range(15):
            strings = list({bytes(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(r.randint(1, 9))})
            x = R.RunLengthIndex(strings, depth=4)
            order = x._sorted()
            tail = {p: s[k:] for s, a in zip(strings, x.starts.tolist(), strict=True) for k, p in enumerate(range(a, a + len(s) + 1))}
            rank, shared = x.matches()
            assert (order[rank] == np.arange(x.n)).all()
            after = [common(tail[int(order[k])], tail[int(order[k + 1])]) if k + 1 < x.n else 0 for k in rank.tolist()]
            assert shared.tolist() == after
            assert x.statistics().tolist() == [max((common(tail[p], tail[q]) for q in range(x.n) if q != p), default=0) for p in range(x.n)]


def test_matches_brute_force(spark, write_sf):
    docs = make(1)
    sf = write_sf(documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, R.op1(spark, sf).collect()), key=str) == brute(docs)


def test_blocks_and_long_texts(spark, tmp_path, monkeypatch):
    docs = make(2, 30) + [(20_000, "ab" * 40_000), (20_001, "ab" * 40_000 + "!")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    import tessera.llm.blocks as B

    pack, pieces = B.pack, B.pieces
    monkeypatch.setattr(R.B, "pack", lambda d, i, t: pack(d, i, t, 500))
    monkeypatch.setattr(R.B, "pieces", lambda d, i, t, e: pieces(d, i, t, e, 500))
    got = R.dedup_substrings(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_segments_of_a_long_text_agree_with_the_whole():
    r = random.Random(8)
    t = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    cut = list(R._segments([t], 700))
    assert all(t[a : a + len(b)] == b for _, a, b in cut) and sum(len(b) - R.SPAN + 1 for *_, b in cut) == len(t) - R.SPAN + 1


def test_odd_rows_and_empty_table(spark, odd_docs, write_sf, tmp_path):
    docs = [(x.doc_id, x.text) for x in odd_docs.collect()]
    assert sorted(map(tuple, R.op1(spark, write_sf(documents=odd_docs)).collect()), key=str) == brute(docs)
    odd_docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert R.op1(spark, str(tmp_path / "e")).count() == 0


def test_popular_anchors_are_cut_into_runs_of_windows(spark, tmp_path):
    """Every anchor counts as popular; and one gram stands in many contexts that share its windows in part."""
    docs = make(4)
    r = random.Random(9)
    gram = "common anchor of all texts"
    tails = ["".join(r.choice("abc") for _ in range(30)) for _ in range(12)]
    docs += [(20_000 + i, r.choice(tails)[r.randint(0, 9) :] + gram + r.choice(tails) + str(i)) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    for hot in (0, 5, 60):
        got = R.dedup_substrings(spark.read.parquet(str(tmp_path / "d")), hot=hot, keep_text=False).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs), hot


def test_runs_cover_every_window_once():
    r = random.Random(2)
    own = R.Passages([bytes(r.choice(b"abcdefgh ") for _ in range(4000)) for _ in range(3)])
    use = np.arange(len(own.hash))
    for hot in (np.zeros(len(use), bool), np.ones(len(use), bool), use % 2 == 0):
        _, at, size, rows, first = own.sent(use, hot)
        windows = sorted((int(d), int(f) + k) for f, n, d in zip(first, size, rows, strict=True) for k in range(n - R.SPAN + 1))
        assert windows == [(d, s) for d in range(3) for s in range(4000 - R.SPAN + 1)]
        assert all(own.raw[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True))


def test_a_changed_second_reading_is_an_error():
    import pytest

    from tessera.llm import blocks as B

    own = R.Passages([b"x" * 10 + bytes(range(97, 123)) * 5])
    keys, _ = own.keys()
    sums = {p: B.checksum(keys[s]) for p, s in B.parts_of(keys, 4)}
    B.same_reading(keys, 4, sums)
    with pytest.raises(ValueError, match="changed"):
        B.same_reading(keys + np.uint64(1), 4, sums)
