import hashlib
import random
import re

from tessera.llm import secretscan as S


def brute(text):
    text, out = text or "", []
    rules = (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        ("access", r"AKIA[A-Z0-9]+", 18, 0),
        ("hex", r"[0-9a-f]+", 16, 0),
    )
    for k, (kind, rule, least, g) in enumerate(rules):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rule, text) if len(m[g]) >= least]
    return [x[2] for x in sorted(out)]


def test_base_spans_match_the_plain_patterns():
    r = random.Random(5)
    parts = ["password", "PassWd", "ſecret", "api_key", "apikey", "token", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123", "é", "x-y_z", "\n", "KEY"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [f"{k}:{a}:{b}" for a, b, k in S.base_spans(t)] == brute(t), t


def test_segmentation_is_the_minimum_over_all_segmentations():
    import math

    def least(v):
        per, n = math.log2(S._space(v)), len(v)
        seg = {}
        for i, j, bits, _ in S.segments(v):
            seg[i, j] = min(seg.get((i, j), math.inf), bits)
        best = [math.inf]

        def go(at, k, total):
            if at == n:
                best[0] = min(best[0], total + math.log2(math.factorial(k)))
                return
            if k == S.MOST_SEGMENTS:
                return
            for j in range(at + 1, n + 1):
                go(j, k + 1, total + min(seg.get((at, j), math.inf), (j - at) * per))

        go(0, 0, 0.0)
        return best[0]

    for v in ("password1", "aaaaaa", "qwerty12", "x9!kQ", "2024-01-31", "abcabcabc", "P4ssw0rd", ""):
        if v:
            assert abs(S.guess_bits(v) - least(v)) < 1e-9, v


def test_weak_values_cost_little_and_random_ones_much():
    for weak in ("password", "changeme", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-31", "abcabcabcabc", "examplepassword"):
        assert S.guess_bits(weak) < 40, weak
    for strong in ("k9#Vq2!xZp7$Lm", "hT7vQz0pLw3nRk8y"):
        assert S.guess_bits(strong) > 60, strong


def test_long_value_is_costed_whole():
    r = random.Random(1)
    value = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    assert S.guess_bits(value) > 1000


def test_odd_rows(spark, odd_docs, write_sf):
    got = sorted(S.scan(odd_docs, redact="#").select("c.doc_id", "r.n_assign", "r.redacted", "r.base_sha256").collect(), key=lambda x: x.doc_id or 0)
    assert len(got) == 10
    by = {x.doc_id: x for x in got}
    assert by[1].redacted is None and by[2].redacted == "" and by[7].n_assign == 1 and by[7].redacted.endswith("\x00 #")
    assert by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.scan(odd_docs.limit(0)).count() == 0
    sf = write_sf(documents=odd_docs.select("doc_id", "text"))
    row = next(x for x in S.op10(spark, sf).collect() if x.doc_id == 7)
    assert row.spans == "assign:21:39"  # a sequence of letters costs few guesses


def test_ordinary_words_of_the_documents_are_no_secrets(spark):
    prose = "Mix the ingredients and read the Zusammenfassung, pwd: hqzkwmxvjtrb."
    weak = ["Secret: ingredients", "pwd: Zusammenfassung", "credential=ingredients."]
    strong = ["pwd: k9#Vq2!xZp7$Lm", "pwd: hqzkwmxvjtrb"]  # one that stands in contexts only, however often
    docs = spark.createDataFrame(list(enumerate([prose] * 4 + weak + strong)), "doc_id long, text string")
    got = {r.doc_id: r.redacted for r in S.scan(docs, redact="#").select("c.doc_id", "r.redacted").collect()}
    assert [got[i] for i in range(4, 7)] == weak
    assert [got[7], got[8]] == ["pwd: #"] * 2 and all(got[i].endswith("pwd: #") for i in range(4))


def test_vocabulary_is_bounded_and_ranked(spark, monkeypatch):
    docs = spark.createDataFrame([("apple berry",)] * 5 + [("apple",), ("cherry",), (None,)], "text string")
    assert list(S.vocabulary(docs))[len(S.WORDS) :] == ["apple", "berry"]
    monkeypatch.setattr(S, "MOST_WORDS", 1)
    assert list(S.vocabulary(docs))[len(S.WORDS) :] == ["apple"]


def test_short_and_long_values_are_costed_whole():
    assert S.guess_spans("pwd=xT7vQz0", 40.0) == [(4, 11, "guess")]
    for weak in ("*" * 100, "abc" * 60, "9876543210" * 9, "*" * 60 + "password" + "=" * 60):
        assert S.guess_bits(weak) < 40 and S.guess_bits(weak, enough=40.0) == S.guess_bits(weak), weak
        assert S.guess_spans("password: " + weak, 40.0) == [], weak


def test_more_than_a_dozen_segments_are_tried():
    thirteen = "theofandtoinisthatforityouwithonas"  # thirteen frequent words
    ranks = [S.RANK[w] for w in "the of and to in is that for it you with on as".split()]
    import math

    assert S.guess_bits(thirteen) <= sum(map(math.log2, ranks)) + math.log2(math.factorial(13)) + 1e-9


def test_walks_follow_neighbouring_keys():
    import math

    assert all(a in S.NEAR[b] for a in S.NEAR for b in S.NEAR[a]) and set(S.NEAR["w"]) == set("qe23as")
    for weak in ("qwertyuiop", "zaq12wsx", "!QAZ@WSX", "asdfghjkl;'", "1qaz2wsx3edc"):
        assert S.guess_bits(weak) < 40, weak
    brute = lambda n, t: sum(math.comb(m - 1, k - 1) * len(S.NEAR) * S.DEGREE**k for m in range(2, n + 1) for k in range(1, min(t, m - 1) + 1)) / 2
    for n in range(3, 12):
        for t in range(1, n):
            assert abs(S.walk_bits(n, t) - math.log2(brute(n, t))) < 1e-9
    long = "qwertyuioplkjhgfdsazxcvbnm" * 4_000  # one walk all along, and a repeat
    assert S.guess_bits(long, enough=40.0) >= 12


def test_query_on_whole_texts(spark, write_sf):
    """Every span of every document, from the plain patterns and a segmentation of each value by itself."""
    r, given = random.Random(12), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    value = lambda: "".join(r.choice("abcdefXYZ0189!+/_") for _ in range(r.randint(3, 30)))
    line = lambda: r.choice(["password: ", "api_key=", "pwd: '", "Secret = ", "token:", ""]) + r.choice([value(), value(), "qwerty123", "deadbeef" * 3, "AKIA" + "X9" * 8, "document"]) + r.choice(["", "'", " "])
    rows = [(x.doc_id, (x.text or "") + "".join("\n" + line() for _ in range(r.randint(0, 3)))) for x in given]
    sf = write_sf(documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranks, texts = S.vocabulary(docs), {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in S.op10(spark, sf).collect()}
    assert got.keys() == texts.keys()
    order, plain = {k: i for i, k in enumerate(S.KINDS)}, re.compile(S.CONTEXT.pattern)
    found = 0
    for i, t in texts.items():
        base = brute(t)
        spans = [tuple(x.split(":")) for x in base]
        for m in plain.finditer(t):
            a, b = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            if least_bits(t[a:b], ranks) >= 40.0:
                spans.append(("guess", str(a), str(b)))
        spans.sort(key=lambda x: (int(x[1]), order[x[0]]))
        found += len(spans) > len(base)
        assert got[i].spans == ",".join(":".join(x) for x in spans)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign:", "access:", "hex:"))
    assert 10 < found < len(texts)


def least_bits(value, ranks):
    """Least over all numbers of segments, place by place, without any bound."""
    import math

    n, per, by = len(value), math.log2(S._space(value)), {}
    for a, b, bits, _ in S.segments(value, ranks):
        by.setdefault(b, []).append((a, bits))
    rows, best = [[0.0] + [math.inf] * n], math.inf
    for k in range(1, n + 1):
        row = [math.inf] * (n + 1)
        for j in range(1, n + 1):
            row[j] = min([rows[-1][i] + (j - i) * per for i in range(j)] + [rows[-1][a] + bits for a, bits in by.get(j, ())])
        rows.append(row)
        best = min(best, row[n] + math.log2(math.factorial(k)))
    return best
