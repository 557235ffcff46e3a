import numpy as np

from tessera.llm import quality as Q


def test_linear_time_score_equals_the_sum_over_pairs():
    r = np.random.default_rng(1)
    m = Q.Model(0.3, r.normal(size=Q.BUCKETS + Q.STATS), r.normal(0, 0.3, (Q.BUCKETS + Q.STATS, Q.RANK)), np.zeros(Q.STATS), np.ones(Q.STATS))
    texts = [b"a b a c!", b"", b"One two\nTWO three 77"]
    rows, cols, x, stats = Q.features(texts)
    got = m.margin(rows, cols, x, stats)[0]
    for i in range(len(texts)):
        ids = [*cols[rows == i], *range(Q.BUCKETS, Q.BUCKETS + Q.STATS)]
        xs = [*x[rows == i], *np.clip(stats[i], -5, 5)]
        want = 0.3 + sum(m.w[a] * v for a, v in zip(ids, xs, strict=True))
        want += sum(m.v[ids[a]] @ m.v[ids[b]] * xs[a] * xs[b] for a in range(len(ids)) for b in range(a))
        assert abs(got[i] - want) < 1e-8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95, auc


def test_odd_rows(spark, odd_docs, write_sf):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (6, 7, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    sf = write_sf(documents=odd_docs, labels=labels)
    got = Q.op6(spark, sf).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    twice = [r.score for r in got if r.doc_id == 4]
    assert len(set(twice)) == 1
    empty = Q.learn(odd_docs.limit(0), labels)
    assert Q.score(odd_docs, empty).count() == 10 and Q.score(odd_docs.limit(0), empty).count() == 0


def test_query_on_a_whole_table_matches_the_sum_over_pairs(spark):
    """Scores from the definition, by the model learned from the rows that may teach; held-out labels change nothing."""
    import zlib

    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    mine = docs.where(~F.col("doc_id").isin([i for i in texts if out(i)]))
    m = Q.learn(mine, labels)
    flipped = Q.learn(mine, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert (m.w == flipped.w).all()
    got = {r.doc_id: r for r in Q.op6(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert r.held_out == out(i) and r.predicted == int(r.score >= 0.5)
        if i % 10:  # the sum over pairs is slow
            continue
        rows, cols, x, stats = Q.features([t])
        ids = np.concatenate([cols, np.arange(Q.BUCKETS, Q.BUCKETS + Q.STATS)])
        xs = np.concatenate([x, np.clip((stats[0] - m.mean) / m.sd, -5, 5)])
        p = m.v[ids] * xs[:, None]
        margin = m.w0 + m.w[ids] @ xs + np.triu(p @ p.T, 1).sum()
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9
