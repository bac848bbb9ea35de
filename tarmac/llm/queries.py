"""Registered queries of the operators on training text, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import (
    byte_bpe,
    decontaminate,
    language_id,
    licenses,
    lm_score,
    mixing,
    prefix_trie,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    spelling,
    token_counts,
)
from tarmac.llm.common import table
from tarmac.llm.oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _on_documents(digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: digest(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": _on_documents(mixing.mix_digest),
    "op2_secret_scan": _on_documents(secrets.secret_digest),
    "op3_simhash": _on_documents(simhash.simhash_digest),
    "op4_quality_model": lambda spark, sf: quality_model.quality_model_digest(
        table(spark, sf, "documents"), table(spark, sf, "labels")
    ),
    "op5_token_counts": _on_documents(
        lambda docs: token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY))
    ),
    "op6_decontamination": lambda spark, sf: decontaminate.contamination_digest(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    ),
    "op7_lm_score": _on_documents(lm_score.lm_digest),
    "op8_quality_rules": _on_documents(quality_rules.quality_digest),
    "op9_license_scan": _on_documents(licenses.licence_digest),
    "op10_language_id": _on_documents(language_id.language_digest),
    "op11_spelling": _on_documents(spelling.spelling_digest),
    "op12_prefix_trie": lambda spark, sf: prefix_trie.trie(table(spark, sf, "conversations")),
    "op13_byte_bpe": _on_documents(
        lambda docs: byte_bpe.byte_bpe_digest(
            docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN
        )
    ),
}

__all__ = ["ORACLE_SQL", "QUERIES"]
