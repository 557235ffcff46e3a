"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``; the result of a stage is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs, also extra ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, neardup, secretscan
from tessera.llm.runtime import stored

#: A prediction with less confidence than this is rejected like one without a letter.
LEAST_SCORE = 0.05


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _all(docs: DataFrame) -> list:
    return [F.col(_quoted(c)) for c in docs.columns]


def _checked(ids: DataFrame) -> DataFrame:
    """A hint to broadcast ids, if there are few enough; else they are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= neardup.MOST_BROADCAST else ids


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language (null, no letter, or no likeness to any profile).

    A document is judged by its whole text alone, so rows that repeat an id or a text are judged alike; ties
    between languages keep it. Without any profile nothing is identifiable; an empty table gives no rows.
    """
    out = langid.identify(docs, langid.learn(docs), carry=docs.columns)
    return out.where((F.col("r.lang_pred") != "und") & (F.col("r.score") >= LEAST_SCORE)).select("c.*")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group (5-word shingles, similarity 0.8).

    Null, empty and word-free texts are in no group and stay, and so do all rows with a null id. Rows that repeat a
    doc_id are judged each by its own text; equal ones are one document, and of several of a group with the smallest
    doc_id one stays.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        members = stored(neardup.NearDuplicates(docs).members(), "members")
        gone = members.where("not kept and doc_id is not null").select("doc_id")
        return docs.join(_checked(gone), "doc_id", "left_anti").select(*_all(docs))
    # ids do not tell these rows apart: the hash of a whole row takes their place
    row = F.struct(*_all(docs))
    rows = named.select(row.alias("c"), F.xxhash64(F.to_json(row)).alias("u"), F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    members = stored(neardup.NearDuplicates(rows.select("u", "t"), "u", "t").members(), "members").select(F.col("doc_id").alias("u"), "component_id")
    owners = members.distinct().join(rows.select("u", "i").distinct(), "u")
    kept = owners.groupBy("component_id").agg(F.min(F.struct("i", "u")).alias("m")).select("m.u")
    once = rows.groupBy("u").agg(F.first("c").alias("c"))
    return once.join(_checked(kept), "u", "left_semi").select("c.*").unionByName(docs.where("doc_id is null"))


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text.

    Null, empty and word-free texts stay; rows that repeat an id or a text are judged each by its own text, whole;
    an empty benchmark drops nothing.
    """
    out = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return out.where(~F.col("r.contaminated")).select("c.*")


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts, overlapping ones as one, and count characters anew; every document stays.

    Null texts stay null and keep n_chars. Rows that repeat an id are redacted each by its own text.
    """
    out = secretscan.scan(docs, carry=docs.columns, redact="[SECRET]")
    size = F.char_length("r.redacted").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    cols = {"text": F.col("r.redacted")} | ({} if size is None else {"n_chars": F.coalesce(size, F.col("c.n_chars"))})
    return out.select(*[cols.get(c, F.col("c." + _quoted(c))).alias(c) for c in docs.columns])


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again as a check value; null texts have no ids. A row for each row."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, P.PATTERN, decoded=True)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("tokens", encode),
]

#: Signatures, segment costs and merges are not for SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
