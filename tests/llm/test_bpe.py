import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken

from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.read_ranks(PATH)), special_tokens={})

VOCABULARY = bpe.Vocabulary.of(bpe.read_ranks(PATH))


def test_merges_are_those_of_the_library_for_words_of_any_length():
    r = random.Random(5)
    for n in [*range(1, 200), 1000, 20_000]:
        for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyzäéß"):
            w = "".join(r.choice(letters) for _ in range(n))
            assert VOCABULARY.merge(w.encode()) == ENC.encode_ordinary(w), w
            assert VOCABULARY._cuts_of_long(w.encode()) == VOCABULARY._cuts(w.encode()) if n < 300 else True


def test_long_texts_are_split_lazily_and_alike():
    split, full = bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    for t in ("some words 12 and, more " * 40_000, "日本 x " * 150_000):
        assert len(t) > bpe.LONG_TEXT
        assert list(split(t)) == full(t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_pre_tokens_and_ids_are_those_of_the_library():
    r, split = random.Random(4), bpe.splitter(P.PATTERN)
    odd = ["a", "Z", "é", "ß", "日本", "١٢", "½", "​", "\x1c", "\x1f", "\x85", "\xa0", "　", " ", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "$", "\U0001f600", "á", "\x00", "٠", "ʼ", "᠎", "﻿"]
    for _ in range(3000):
        t = "".join(r.choice(odd) for _ in range(r.randint(0, 12)))
        own = [i for w in split(t) for i in VOCABULARY.merge(w.encode())]
        assert own == ENC.encode_ordinary(t), repr(t)


def test_plain_texts_are_split_alike_by_both_patterns():
    assert bpe.USUAL == P.PATTERN
    r, split, full = random.Random(6), bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    plain = "aZéÖÿĀɏ×÷09 \t\n\r\x0b\x0c'stremvdl!$~_-" + "  "
    for _ in range(5000):
        t = "".join(r.choice(plain) for _ in range(r.randint(0, 14)))
        assert split(t) == full(t), repr(t)
    assert all(regex.match(r"\p{L}", chr(c)) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)) for c in range(a, b + 1))


def test_query_matches_the_library(spark, odd_docs, write_sf):
    sf = write_sf(documents=odd_docs.repartition(3))
    got = sorted(map(tuple, bpe.op3(spark, sf).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = ENC.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want, key=str)


def test_decode_refuses_unknown_ids_and_keeps_null(spark):
    df = spark.createDataFrame([(1, [5, 6], b"x"), (2, None, None), (3, [], None)], "doc_id long, token_ids array<int>, decoded binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: bytearray(ENC.decode_bytes([5, 6])), 2: None, 3: bytearray()}
    bad = spark.createDataFrame([(1, [50256])], "doc_id long, token_ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, PATH).collect()


def test_empty_table(spark, odd_docs, write_sf):
    assert bpe.op3(spark, write_sf(documents=odd_docs.limit(0))).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(spark, write_sf):
    rows = [(1, "one two"), (1, "three"), (1, "one two"), (None, "four"), (None, "")]
    got = sorted((r.doc_id, list(r.token_ids), bytes(r.decoded).decode()) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, decoded=True).collect() if r.doc_id)
    assert got == sorted((i, ENC.encode_ordinary(t), t) for i, t in rows if i)


def test_a_task_forgets_words_and_goes_on(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_DONE", 10)
    texts = [f"alpha{i % 7} beta gamma{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: list(r.token_ids) for r in bpe.encode(df, PATH, P.PATTERN).collect()} == {i: ENC.encode_ordinary(t) for i, t in enumerate(texts)}
