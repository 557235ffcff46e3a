import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(doc, items):
    d, hit, found = lower(doc), set(), set()
    for name, text in items:
        w = lower(text)
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1 if n else 0):
            if tuple(d[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(d), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(d)


def make(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "Été", "x1", "the", "of"]
    gen = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, gen(r.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(12)] + [(12, None), (13, "")]
    items += [(20, items[-3][1]), (21, "one TWO three")]
    docs = []
    for i in range(60):
        t = gen(r.randint(0, 60))
        if r.random() < 0.6:
            _, own = r.choice(items)
            own = (own or "").split(" ")
            a = r.randint(0, len(own))
            t += " " + " ".join(own[a:]).upper() + " " + gen(5)
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, "say one, two -- three!"), (92, "say one, two -- three!")], items


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_matches_brute_force_with_one_and_many_blocks(spark, write_sf):
    docs, items = make(3)
    sf = write_sf(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert rows(decontam.op5(spark, sf)) == want
    many = decontam.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), block_bytes=300)
    got = sorted((x.c.doc_id, x.r.n_words, x.r.n_hit, x.r.n_items, decontam.items_digest(x.r["items"]), x.r.contaminated) for x in many.collect())
    assert got == want


def test_odd_rows_and_empty_tables(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.decontaminate(odd_docs, none).select("c.doc_id", "r.n_words", "r.n_hit").collect()
    assert len(got) == 10 and all(x.n_hit == 0 for x in got)
    some = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    got = {x.doc_id: x.n_hit for x in decontam.decontaminate(odd_docs, some).select("c.doc_id", "r.n_hit").collect()}
    assert got[3] == got[4] == 18 and got[1] == got[2] == 0
    assert decontam.decontaminate(odd_docs.limit(0), some).count() == 0


def test_items_without_an_id_count_but_are_not_listed(spark):
    items = [(None, "one two three"), (None, "four five six"), (7, "seven eight nine")]
    docs = spark.createDataFrame([(1, "say one two three"), (2, "four five six, one two three"), (3, "seven eight nine one two three")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 70):
        got = decontam.decontaminate(docs, bench, block_bytes=size).select("c.doc_id", "r.n_hit", "r.n_items", "r.items", "r.contaminated")
        assert rows(got) == [(1, 3, 1, [], True), (2, 6, 1, [], True), (3, 6, 2, ["7"], True)], size


def test_repeated_words_cost_no_pairs():
    import time

    began = time.time()
    index = decontam.Index([("i", b"x " * 5_000), ("j", b"x " * 12)], 5, 13)
    n, hits, found = index.find([b"y " * 30 + b"x " * 20_000])
    assert n[0] == 20_030 and hits[0].sum() == 20_000 and found[0] == {0, 1}
    assert time.time() - began < 5


def test_the_kept_fingerprint_depends_on_the_window_alone():
    import numpy as np

    r = np.random.default_rng(2)
    for w in (1, 2, 3, 8, 9):
        x = r.integers(0, 4, 200).astype(np.uint64)
        got = decontam._rightmost_min(x, w)
        want = [i + max(j for j in range(w) if x[i + j] == x[i : i + w].min()) for i in range(len(x) - w + 1)]
        assert got.tolist() == want


def test_large_benchmarks_go_through_a_shuffle(spark, odd_docs):
    """Spans, items without an id, rows that repeat an id with other texts: as with the broadcast index."""
    docs, items = make(11)
    docs += [(None, docs[0][1]), (5, items[4][1]), (5, "x " * 300)]
    items += [(None, items[5][1]), (40, "x " * 50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = (decontam.decontaminate(d, b, carry=["doc_id", "text"], block_bytes=n) for n in (1 << 20, 100))
    flat = lambda df: sorted(map(str, df.select("c.*", "r.*").collect()))
    assert flat(one) == flat(two)
    odd = odd_docs.select("doc_id", F.col("text"))
    assert flat(decontam.decontaminate(odd, b, block_bytes=100)) == flat(decontam.decontaminate(odd, b))


def test_words_of_equal_hash_are_kept_apart(monkeypatch):
    """Whatever the hashes, only equal words hit."""
    import numpy as np

    monkeypatch.setattr(decontam.K, "grams", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    docs, items = make(4)
    index = decontam.Index([(str(i), (t or "").encode()) for i, t in items], 5, 13)
    n, hits, found = index.find([(t or "").encode() for _, t in docs])
    for i, (_, t) in enumerate(docs):
        names = {x for j in found.get(i, ()) for x in index.names[j]}
        got = (int(n[i]), int(hits[i].sum()) if i in hits else 0, len(names), decontam.items_digest(names))
        assert got == brute(t, items)[:4]
