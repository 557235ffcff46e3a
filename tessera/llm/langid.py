"""Language identification by rank-order profiles.

A profile is a language's ``top`` most frequent letter n-grams (n = 1 to 3, a
word's edges count as a blank) by falling count, ties by code. A document's
own ranking is compared with each profile by the out-of-place distance: the
sum over its n-grams of the difference of ranks, ``top`` for an n-gram that
the profile lacks. The least distance wins, ties by name.

Texts without a letter, and null, are ``und`` with score 0; so is every text
if nothing was learned. The score is 1 minus the distance over the largest
possible one. Texts of any length are ranked whole. Equal texts get equal results,
also under one doc_id; an empty table gives no rows and teaches nothing. Extra columns
are ignored, whatever their names.

Plan: learning is one scan that sums n-gram counts for each language within a
batch, one shuffle of (language, n-gram) sums, and ``top`` rows for each
language back to the driver. Prediction is one scan without a shuffle; the
profiles in its closure are bounded by languages x ``top``. Languages above
``MOST_LANGUAGES`` are refused rather than broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import attach, ship

TOP, MOST_LANGUAGES = 300, 2000
RESULT = "lang_pred string, score double"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    global _LETTER
    if _LETTER is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTER = out
    return _LETTER


def codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text (uint64; higher bits tell n); empty if it has no letter."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not c.any():
        return np.zeros(0, np.uint64)
    x = np.concatenate([[0], c, [0]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]  # one blank between words
    two = x[:-1] << np.uint64(21) | x[1:]
    three = two[:-1] << np.uint64(21) | x[2:]
    three = three[x[1:-1] != 0]  # a blank in the middle joins two words
    return np.concatenate([x[x != 0], two | np.uint64(1 << 62), three | np.uint64(1 << 63)])


def ranking(text: str, top: int = TOP) -> np.ndarray:
    """A document's n-grams, most frequent first."""
    c = codes(text)
    if not len(c):
        return c
    keys, n = np.unique(c, return_counts=True)
    if len(keys) > top:  # only those that can be in the first ``top``
        least = np.partition(n, len(n) - top)[len(n) - top]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.argsort(-n, kind="stable")[:top]]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles of every language of ``docs`` (rows without language or text teach nothing)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[np.ndarray]] = {}
            held = 0

            def flush():
                for lang, parts in by.items():
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(c := codes(text))
                held += len(c)
                if held > 4 << 20:
                    yield from flush()
                    by, held = {}, 0
            yield from flush()

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # unsigned order of the codes, as in ranking(); salted first ranks so that one language is never one task
    key = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    first = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), key)
    last = Window.partitionBy("lang").orderBy(F.desc("n"), key)
    best = sums.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    best = best.withColumn("k", F.row_number().over(last)).where(F.col("k") <= top).select("lang", "gram", "k")
    n = docs.agg(F.count_distinct(f"`{lang_col}`")).first()[0]  # without the texts
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; profiles of at most {MOST_LANGUAGES} are broadcast")
    out: dict[str, list[int]] = {}
    for r in best.sort("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Judge:
    """Distances of a document to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names = sorted(profiles)
        self.top = top
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for j, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[n]), j] = np.arange(len(profiles[n]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranking(text, self.top) if text else ()
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        r = self.ranks[at]
        d = np.where(r < 0, self.top, np.abs(r - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(d))
        return self.names[best], 1.0 - float(d[best]) / (self.top * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", carry: list[str] | None = None, top: int = TOP) -> DataFrame:
    """Columns ``c`` (carried) and ``r`` (lang_pred, score), one row for each document row."""
    ship(docs.sparkSession)
    judge = Judge(profiles, top)

    def fn(cols):
        got = [judge(t) for t in cols[text_col].to_pylist()]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return attach(docs, [text_col], list(carry or ["doc_id"]), fn, RESULT)


def held_out(col: str, n: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``n``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n == rest, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn(docs.where(~held_out("doc_id", 4, 2))))
    return out.select("c.doc_id", held_out("c.doc_id", 4, 2).alias("held_out"), "r.lang_pred", "r.score")
