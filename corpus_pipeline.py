"""Corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Every stage judges each row by its own text, so null ids, repeated ids and extra columns do no harm: columns
are kept as they are, whatever they are called. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_replay, decontaminate, langid_kn, secrets_crf, simhash_golay
from tidemark.llm.common import dropped, held_out, saved, table


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models tell.

    Null, empty and letterless texts go, as do texts unlike all that the models have seen; without a single
    row to learn from everything goes. Repeated rows go or stay alike.
    """
    return langid_kn.accepted(docs, langid_kn.fit(docs.where(~held_out("doc_id", 4, 2))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Of rows with one id one stays, the one whose text hashes lowest; rows with a null id all stay.
    """
    return simhash_golay.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without contamination by the benchmark; a text without words has none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark and n_chars counted anew; a null text stays null, with null n_chars."""
    return secrets_crf.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row that is left; a null or empty text has no tokens."""
    return bpe_replay.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_known),
    ("near_dedup", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("byte_bpe", tokenised),
]

#: Fitted models and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if made is not None:  # what the stage has read is not needed any more
            dropped(made)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)
