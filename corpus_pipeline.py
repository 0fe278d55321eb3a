"""A corpus pipeline over documents: five stages, each applying one operator to all that its predecessor kept.

Language ID drops documents without a language; near-duplicate detection keeps one document of each group; the secret
scan redacts what it finds; mixing takes each source's documents to its target; encoding gives ids, checked by decoding.
The last stage returns doc_id, source, n_tokens and the digests of ids and decoded text.

Defined results: a null text, and one without a letter, has no language and goes at the first stage, so empty texts go
too; where no row has a lang nothing can be learnt and all rows go; a null doc_id is never a training row and comes last
when one row of a group is kept; a null source is a source of its own; null lang and n_chars stay null; of repeated rows
one stays; texts of any length are read whole; an empty table gives an empty result; further columns are kept up to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chunk_reuse, langid, mixing, secrets, simhash
from tidemark.session import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints meet in the grid of op8 and whole sets confirm them; the rest of what
    shares four of five of its five-word shingles or more is found by shingles."""
    return simhash.keep_one(docs, simhash.COPY_SHINGLE, simhash.COPY_SIMILARITY)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text."""
    return secrets.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as counts and digests."""
    return chunk_reuse.digest(docs, keep=("source",))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: SQL can express neither the trained model nor the tokenizer; tests/llm checks the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
