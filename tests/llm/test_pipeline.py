import hashlib
import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import test_decontam
import test_neardup

import corpus_pipeline
from tessera.llm import bpe, secretscan

ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})


def plain(docs, items):
    """The pipeline in plain Python; language ID rejects texts without a letter."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    kept = {d for d, _, _, k in test_neardup.brute([d for d in docs if d[0] is not None], 5) if k}
    seen, out = set(), []
    for i, t in docs:
        if i is None or i in kept and i not in seen:
            seen.add(i)
            if test_decontam.brute(t, items)[4]:
                continue
            spans, done, at = sorted(secretscan.base_spans(t) + secretscan.guess_spans(t, 40.0)), "", 0
            for a, b, _ in spans:
                if a >= at:
                    done += t[at:a] + "[SECRET]"
                at = max(at, b)
            t = done + t[at:]
            out.append((i, ENC.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, list(r.token_ids), r.decoded_sha256) for r in got), key=str) == plain(docs, items)
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_odd_rows_keep_their_columns(spark, odd_docs, write_sf):
    items = [(1, "never in the texts at all")]
    sf = write_sf(documents=odd_docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    got = corpus_pipeline.run(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, list(r.token_ids), r.decoded_sha256) for r in got), key=str) == plain(rows, items)


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark, write_sf):
    text = {k: " ".join(f"{chr(97 + k)}{n}x" for n in range(40)) for k in range(6)}
    rows = [
        (7, text[0]),  # the copy of document 3 goes, the other texts of id 7 stay
        (7, text[1]),
        (7, text[1]),
        (7, text[2]),
        (7, text[2] + " and one word"),
        (3, text[0] + " more"),
        (9, text[2]),
        (8, ""),
        (8, None),
        (None, text[0]),
        (None, text[0]),
        (2, text[4]),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long").repartition(4)
    docs = spark.read.parquet(write_sf(documents=docs) + "/documents.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    of_seven = [t for i, t in got if i == 7]
    assert text[1] in of_seven and len(of_seven) == 2
    assert len({text[2], text[2] + " and one word"} & set(of_seven)) == 1
    rest = [(3, text[0] + " more"), (8, ""), (8, None), (None, text[0]), (None, text[0]), (2, text[4])]
    assert sorted((x for x in got if x[0] != 7), key=str) == sorted(rest, key=str)


def test_empty_table(spark, odd_docs, write_sf):
    none = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, write_sf(documents=odd_docs.limit(0), benchmark=none)).count() == 0
