from collections import Counter

import numpy as np

from tessera.llm import langid as L


def brute_codes(text):
    out = Counter()
    padded, prev_blank = [], False
    for ch in " " + text + " ":
        c = ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " "
        if c == " " and padded and padded[-1] == " ":
            continue
        padded.append(c)
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if n == 1 and g == [" "] or n == 3 and g[1] == " ":
                continue
            out["".join(g)] += 1
    return out


def test_ngrams_and_ranking_match_brute_force():
    for text in ("Hello, World!", "a", "Straße 12 für ÄÖ", "x  y\tz", "日本語 テスト"):
        want = brute_codes(text)
        keys, n = np.unique(L.codes(text), return_counts=True)
        assert sorted(n.tolist()) == sorted(want.values())
        assert len(L.ranking(text, 5)) == min(5, len(want))
    assert len(L.codes("12 !?")) == 0 and len(L.codes("")) == 0


def test_distance_matches_brute_force():
    profiles = {"b": L.ranking("the cat and the dog"), "a": L.ranking("der hund und die katze")}
    own = L.ranking("the hat")
    best = None
    for name in sorted(profiles):
        place = {int(g): i for i, g in enumerate(profiles[name])}
        d = sum(abs(place[int(g)] - i) if int(g) in place else L.TOP for i, g in enumerate(own))
        if best is None or d < best[0]:
            best = (d, name)
    name, score = L.Judge(profiles)("the hat")
    assert name == best[1] == "b" and abs(score - (1 - best[0] / (L.TOP * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    got = L.op2(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_odd_rows_and_nothing_learned(spark, odd_docs, write_sf):
    sf = write_sf(documents=odd_docs)
    got = L.op2(spark, sf).collect()
    assert len(got) == 10
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 8)} == {1: "und", 2: "und", 8: "und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert L.learn(odd_docs.limit(0)) == {}
    assert {r.r.lang_pred for r in L.identify(odd_docs, {}).collect()} == {"und"}
    assert L.identify(odd_docs.limit(0), {}).count() == 0


def test_query_on_a_whole_table_matches_brute_force(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    place = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    ranked = lambda n: {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], place(x[0])))[:300])}
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    sums = {}
    for r in docs:
        if r.lang is not None and r.text is not None and not out(r.doc_id):
            sums.setdefault(r.lang, Counter()).update(brute_codes(r.text))
    profiles = {k: ranked(v) for k, v in sums.items()}
    got = {r.doc_id: r for r in L.op2(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own, x = ranked(brute_codes(r.text or "")), got[r.doc_id]
        assert x.held_out == out(r.doc_id)
        if not own:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - i) if g in p else 300 for g, i in own.items()) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert x.lang_pred == best and abs(x.score - (1 - far[best] / (300 * len(own)))) < 1e-12


def test_rows_that_repeat_an_id_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (1, "der hund und die katze"), (1, "12")], "doc_id long, text string")
    profiles = {"en": L.ranking("the cat and the dog"), "de": L.ranking("der hund und die katze")}
    assert sorted(r.lang_pred for r in L.identify(docs, profiles).select("r.lang_pred").collect()) == ["de", "en", "und"]
