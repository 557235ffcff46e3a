"""Queries of this subpackage for the entry module, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontam, langid, matroska, neardup, ngramlm, quality, runindex, secretscan, sql, warc

QUERIES = {
    "op1_substring_dedup": runindex.op1,
    "op2_langid": langid.op2,
    "op3_bpe": bpe.op3,
    "op4_warc": warc.op4,
    "op5_decontaminate": decontam.op5,
    "op6_quality": quality.op6,
    "op7_ngram_lm": ngramlm.op7,
    "op8_neardup": neardup.op8,
    "op9_matroska": matroska.op9,
    "op10_secrets": secretscan.op10,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": sql.OP1,
    "op4_warc": sql.OP4,
    "op5_decontaminate": sql.OP5,
    "op8_neardup": sql.OP8,
}
