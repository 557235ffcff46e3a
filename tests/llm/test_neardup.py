import random
import re

from tessera.llm import neardup as N
from tessera.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(t, k):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k=4):
    sets = [shingle_set(t, k) for _, t in docs]
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(x, y) for v in where.values() for x in v for y in v if x < y}
    for x, y in pairs:
        both = len(sets[x] & sets[y])
        if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            par[find(x)] = find(y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def test_matches_brute_force(spark, write_sf):
    r, docs = random.Random(11), []
    vocab = ["w%d" % i for i in range(400)]
    for i in range(80):
        base = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 30, 200]))]
        docs.append((1000 - len(docs), " ".join(base)))
        for _ in range(r.choice([0, 0, 1, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, len(w) // 30])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((1000 - len(docs), " ".join(w).upper()))
    docs += [(2001, None), (2002, "")]
    sf = write_sf(documents=spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, N.op8(spark, sf).collect())) == brute(docs)


def test_crowd_of_copies_on_both_sides_of_the_limit(spark, write_sf):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(3000)]
    base, docs = [r.choice(vocab) for _ in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(2, 9)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, " ".join(w)))
    sf = write_sf(documents=spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute(docs)
    assert 1 < len({w[2] for w in want}) < 160
    assert sorted(map(tuple, N.op8(spark, sf).collect())) == want


def test_whole_table_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, N.op8(spark, "/root/testdata/sf0.001").collect())) == brute(docs)


def test_odd_rows_and_empty_table(spark, odd_docs, write_sf):
    got = sorted(map(tuple, N.op8(spark, write_sf(documents=odd_docs)).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == 10 and by[4][2:] == (3, False) and by[3][2:] == (3, True)
    assert by[6][2:] == (5, False) and by[1] == (1, 0, 1, True) and by[8] == (8, 0, 8, True) and by[None][2] is None
    assert N.NearDuplicates(odd_docs.limit(0)).members().count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(700, 700)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in range(500, 600)) and 700 not in got


def test_lone_pairs_in_a_crowd_far_larger_than_any_window(spark):
    # 137 of 156 shingles are everyone's, similarity 0.783; a pair shares two more, similarity 0.803
    n, lone = 6_000, 1_000
    base = " ".join("w%d" % i for i in range(140))
    docs = []
    for i in range(n):
        own = ["d%d_%d" % (i, j) for j in range(19)]
        if i % (n // 2) < lone:
            own[:2] = ["p%d" % (i % (n // 2)), "q%d" % (i % (n // 2))]
        docs.append((i, " ".join([base, *own])))
    few = brute([docs[i] for i in (0, 1, n // 2, n // 2 + 1, n - 1)])
    assert [w[2] for w in few] == [0, 1, 0, 1, n - 1]
    got = {r.doc_id: r.component_id for r in N.NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=4).members().collect()}
    assert got == {i: i - n // 2 if n // 2 <= i < n // 2 + lone else i for i in range(n)}


def test_links_do_not_depend_on_batches_or_ranges(spark):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(2000)]
    base, docs = [r.choice(vocab) for _ in range(120)], []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(3, 9)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, " ".join(w)))
    want, key = brute(docs), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for size, n in (("5", "2"), ("64", "7")):
            spark.conf.set(key, size), spark.conf.set("spark.sql.shuffle.partitions", n)
            df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
            assert sorted(map(tuple, N.NearDuplicates(df, k=4).members().collect())) == want
    finally:
        spark.conf.set(key, before), spark.conf.set("spark.sql.shuffle.partitions", parts)
