"""Secret scan: fixed patterns, and guess cost of values in a credential context.

Three patterns give the base spans. Beside them, every value that stands in a
credential context (a key word, a separator, a value) is segmented at minimum
cost by dynamic programming: a segment is a common word (also with letter
substitutions), a date, a repeat, a walk over neighbouring keys with few turns, a
sequence or brute force,
and costs the guesses an attacker needs for it; k segments cost their product
times k!. A value whose cost is at least ``2 ** min_bits`` guesses is a secret
and adds a span ``guess`` over the value; base spans always stay.

Common words are a short fixed list and after it the ``MOST_WORDS`` words that
most of the documents at hand hold, at least ``LEAST_DOCS`` of them; words are runs of up
to ``LONGEST_WORD`` letters of one case (or a capital first), and what stands in a
credential context or a base span is not counted, so that no secret becomes a word.
An ordinary word that is rarer than these still costs what its letters cost.

Null and empty texts have no spans. A value is costed whole
whatever its length: repeats, sequences and walks are runs as long as they go, and
the number of segments is free. Only what cannot bring a value below ``min_bits`` is
left out: k segments when k! alone is as many guesses, and repeats of a unit whose
letters alone cost as much. So time is linear in the value. Texts of any length are
scanned whole. Overlapping spans all stay and are redacted as one run; equal starts are
ordered by kind. Rows that repeat a doc_id are scanned each by its own text, and equal
texts have equal spans. An empty table gives no rows. Extra columns are ignored,
whatever their names. The counts of words are the only shuffle; the vocabulary is
broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import attach, ship, stored

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?ai)(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential|auth_?key|private_?key)"""
    r"""["']?\x20*[:=]\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))"""
)
#: Words of the documents that count as common, the documents that have to hold one, and its letters at most.
MOST_WORDS, LEAST_DOCS, LONGEST_WORD = 100_000, 3, 40
#: A counter of words is sent on when it holds so many.
HELD = 200_000
WORD = re.compile(rf"(?<!\w)[^\W\d_]{{2,{LONGEST_WORD}}}(?!\w)")
#: Words by descending frequency; the rank is the guess cost.
WORDS = (
    "password the of and to in is that for it you with on as are this be at or from his an they which "
    "one had by word but not what all were we when your can said there use each she do how their if will "
    "up other about out many then them these so some her would make like him into time has look two more "
    "write go see number no way could people my than first water been call who oil its now find long down "
    "day did get come made may part admin welcome login letmein monkey dragon master qwerty shadow sunshine "
    "princess football baseball secret test user guest root hello love summer winter spring autumn default "
    "changeme example sample dummy placeholder none null true false token api key"
).split()


class Ranks(dict):
    """Rank of each word, in the order given."""

    def __init__(self, words):
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self.longest = max(map(len, self), default=0)

    def __reduce__(self):
        return Ranks, (list(self),)


RANK = Ranks(WORDS)
LEET = str.maketrans("4@831!0$57", "aabeiiosst")
# Rows of keys, and how far each row is shifted, in quarters of a key.
KEYS = (("1234567890-=", 0), ("qwertyuiop[]", 2), ("asdfghjkl;'", 3), ("zxcvbnm,./", 5))
SHIFTED = str.maketrans("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./")


def _keyboard() -> dict[str, dict[str, tuple[int, int]]]:
    """For each key its neighbours (at most a key off, also in the next row) with the direction to them."""
    place = {k: (4 * i + shift, 4 * row) for row, (keys, shift) in enumerate(KEYS) for i, k in enumerate(keys)}
    near = lambda a, b: abs(a[1] - b[1]) <= 4 and abs(a[0] - b[0]) <= (4 if a[1] == b[1] else 3)
    sign = lambda x: (x > 0) - (x < 0)
    return {a: {b: (sign(q[0] - p[0]), sign(q[1] - p[1])) for b, q in place.items() if a != b and near(p, q)} for a, p in place.items()}


NEAR = _keyboard()
DEGREE = sum(map(len, NEAR.values())) / len(NEAR)


@cache
def walk_bits(length: int, turns: int) -> float:
    """log2 of half the walks of up to ``length`` keys and ``turns`` straight stretches: half the keys times the sum over t of (C(length, t) - 1) DEGREE**t."""
    terms = [math.log2(math.comb(length, t) - 1) + t * math.log2(DEGREE) for t in range(1, min(turns, length - 1) + 1)]
    high = max(terms)
    return math.log2(len(NEAR) / 2) + high + math.log2(math.fsum(2.0 ** (x - high) for x in terms))


#: Segments of a value: as many as are cheapest.
MOST_SEGMENTS = math.inf
DATE = re.compile(r"(?:\d{4}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _space(text: str) -> int:
    """Size of the alphabet that brute force must try."""
    n = 0
    n += 26 * any("a" <= c <= "z" for c in text)
    n += 26 * any("A" <= c <= "Z" for c in text)
    n += 10 * any("0" <= c <= "9" for c in text)
    n += 33 * any(c.isascii() and not c.isalnum() for c in text)
    n += 100 * any(not c.isascii() for c in text)
    return max(n, 1)


def _repeats(value: str, enough: float):
    """(start, end, unit) of the longest repeat of each unit that is cheaper than ``enough`` bits, from each place."""
    n = len(value)
    chars = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    for unit in range(1, n // 2 + 1):
        if unit * math.log2(10) >= enough:  # no alphabet is smaller
            break
        differ = np.flatnonzero(np.append(chars[unit:] != chars[:-unit], True))
        at = np.arange(n - unit)
        times = (differ[np.searchsorted(differ, at)] - at) // unit + 1
        for i in np.flatnonzero(times >= 2).tolist():
            yield i, i + int(times[i]) * unit, unit


def _walks(keys: str, i: int, enough: float):
    """Walks over neighbouring keys that begin here, to the end of each straight stretch of three keys or more in all."""
    j, turns, way = i + 1, 0, None
    while j < len(keys) and (step := NEAR.get(keys[j - 1], {}).get(keys[j])) is not None:
        if step != way:
            if j - i >= 3:
                yield i, j, walk_bits(j - i, turns), "walk"
            turns, way = turns + 1, step
            if turns * math.log2(DEGREE) >= enough:  # more only cost more
                return
        j += 1
    if j - i >= 3:
        yield i, j, walk_bits(j - i, turns), "walk"


def segments(value: str, ranks: Ranks = RANK, enough: float = math.inf):
    """(start, end, log2 guesses, kind) of every segment that is cheaper than brute force may be, and than ``enough``."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    keys = low.translate(SHIFTED)
    for i, j, unit in _repeats(value, enough):
        if unit > 1:
            yield i, j, unit * math.log2(_space(value[i : i + unit])) + math.log2((j - i) // unit), "repeat"
        elif j - i >= 3:
            yield i, j, math.log2(_space(value[i]) * (j - i)), "repeat"
    for i in range(n):
        for j in range(i + 2, min(n, i + ranks.longest) + 1):
            if (w := low[i:j]) in ranks:
                yield i, j, math.log2(ranks[w]) + (value[i:j] != w), "word"
            elif (w := plain[i:j]) in ranks:
                yield i, j, math.log2(ranks[w]) + 1 + (value[i:j].lower() != value[i:j]), "word"
        if m := DATE.match(value, i):
            yield i, m.end(), math.log2(365 * 120) + (2 if m[1] or m[2] else 0), "date"
        for step in (1, -1):
            j = i + 1
            while j < n and ord(low[j]) - ord(low[j - 1]) == step and low[j].isalnum():
                j += 1
            if j - i >= 3:
                yield i, j, math.log2(4 * (j - i) * (10 if value[i].isdigit() else 26)), "sequence"
        yield from _walks(keys, i, enough)


def guess_bits(value: str, ranks: Ranks = RANK, enough: float = math.inf) -> float:
    """log2 of the guesses of the cheapest segmentation of the whole value; exact below ``enough``, else no less than it."""
    n = len(value)
    if not n:
        return 0.0
    brute = np.arange(n + 1) * math.log2(_space(value))
    found = [x[:3] for x in segments(value, ranks, enough)]
    start, end = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    bits = np.array([x[2] for x in found], float)
    # row[j]: bits of the first j characters in k segments; a brute-force run may be of any
    # length, so only the lowest start (bits minus its length's bits) has to be kept
    row, best, orders = np.full(n + 1, math.inf), math.inf, 0.0
    row[0] = 0.0
    for k in range(1, n + 1):
        orders += math.log2(k)
        if orders >= min(best, enough):  # more segments only cost more
            break
        last, row = row, np.full(n + 1, math.inf)
        row[1:] = np.minimum.accumulate((last - brute)[:-1]) + brute[1:]
        np.minimum.at(row, end, last[start] + bits)
        best = min(best, float(row[n]) + orders)
    return best


# What a credential context has to hold, in lower case.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "authkey", "auth_key", "privatekey", "private_key")
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def hints(text: str) -> tuple[bool, bool, bool]:
    """Whether a text may hold a credential context, an access key, a run of hex digits; patterns run only where it may."""
    low = text.lower()
    return any(h in low for h in HINTS), "AKIA" in text, b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    context, access, digits = hints(text)
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if context else []
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if access else []
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)] if digits else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, min_bits: float, ranks: Ranks = RANK) -> list[tuple[int, int, str]]:
    out = []
    for m in CONTEXT.finditer(text) if hints(text)[0] else ():
        g = next(k for k in (1, 2, 3) if m[k] is not None)
        if guess_bits(m[g], ranks, min_bits) >= min_bits:
            out.append((m.start(g), m.end(g), "guess"))
    return out


def _words(text: str) -> set[str]:
    """The words of a text outside its base spans and credential contexts."""
    context, access, digits = hints(text)
    text = ASSIGN.sub(" ", CONTEXT.sub(" ", text)) if context else text
    text = ACCESS.sub(" ", text) if access else text
    text = HEX.sub(" ", text) if digits else text
    return {w.lower() for w in set(WORD.findall(text)) if w.islower() or w.isupper() or w[1:].islower()}


def vocabulary(docs: DataFrame, text_col: str = "text") -> Ranks:
    """The fixed words, then those that most documents hold; of words held equally often all or none."""

    def run(batches):
        held = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(_words(text.as_py()))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": list(held.values())})
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    texts = docs.select(F.col("`" + text_col.replace("`", "``") + "`").alias("t")).where("t is not null")
    counts = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    counts = stored(counts, "words")
    total, least = 0, None
    # numbers of documents are as many as the input makes them; the first MOST_WORDS of them are all that is read
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += r["count"]
        if total > MOST_WORDS:
            break
        least = r.n
    found = [] if least is None else counts.where(F.col("n") >= least).collect()
    found.sort(key=lambda r: (-r.n, r.word))
    return Ranks([*WORDS, *(r.word for r in found if r.word not in RANK)])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>, redacted string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, min_bits: float = 40.0, redact: str | None = None) -> DataFrame:
    """Columns ``c`` (carried) and ``r`` (see RESULT), one row for each document row.

    redacted: with ``redact`` given, the text with each covered run replaced by
    it (null stays null); else null. Offsets are code points, ends exclusive.
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text_col))

    def fn(cols):
        out = {x: [] for x in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")}
        for text in cols[text_col].to_pylist():
            base = base_spans(text or "")
            spans = sorted(base + guess_spans(text or "", min_bits, ranks.value), key=lambda s: (s[0], KINDS.index(s[2])))
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
            out["spans"].append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            done = None
            if redact is not None and text is not None:
                pieces, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        pieces += [text[at:a], redact]
                    at = max(at, b)
                done = "".join(pieces) + text[at:] if spans else text
            out["redacted"].append(done)
        return out

    return attach(docs, [text_col], list(carry or [id_col]), fn, RESULT)


def op10(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = F.concat_ws(",", F.transform("r.spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("c.doc_id", "r.n_assign", "r.n_access", "r.n_hex", "r.base_sha256", joined.alias("spans"))
