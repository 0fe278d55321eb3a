"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    chunk_reuse,
    collocations,
    html_text,
    langid,
    lengths,
    media,
    mixing,
    packing,
    quality,
    ranked_search,
    secrets,
    simhash,
    token_output,
)
from tidemark.session import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman-coded ids of all documents, read back."""
    return token_output.digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the forest's verdict."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents to target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded lengths of all documents with totals at every context limit."""
    return lengths.context_report(lengths.histogram(table(spark, sf_dir, "documents")))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts stored as media, found again by digest in interleaved sequences."""
    return media.digest(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by chunks and decoded."""
    return chunk_reuse.digest(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences along a space-filling curve."""
    return packing.digest(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of documents."""
    return collocations.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    found = (
        op1_token_output,
        op2_quality_rules,
        op3_secret_scans,
        op4_source_mixing,
        op5_language_id,
        op6_token_lengths,
        op7_media_columns,
        op8_simhash_groups,
        op9_main_text,
        op10_bpe_chunk_reuse,
        op11_ranked_search,
        op12_curve_packing,
        op13_collocations,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op3_secret_scans": secrets.ORACLE, "op4_source_mixing": mixing.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op13_collocations": collocations.ORACLE}
