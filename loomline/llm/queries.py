"""The operators applied to whole tables, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .shared import shared_dir, table


def tokenizer_path() -> str:
    """The default vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    path = shared_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_files.id_checksums(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove_later_copies(table(spark, sf_dir, "documents")).drop("kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    path = f"{shared_dir(spark)}/sequences"
    packing.write_buckets(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()), path)
    return packing.piece_digest(packing.read_buckets(spark, path))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.span_digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import personal_data

    return personal_data.span_digest(personal_data.scan(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical_search

    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_warc,
        op3_token_files,
        op4_decontamination,
        op5_substring_dedup,
        op6_quality_rules,
        op7_suffix_dedup,
        op8_license_scan,
        op9_packing,
        op10_secret_scan,
        op11_personal_data,
        op12_lexical_search,
        op13_collocations,
    )
}

ORACLE: dict[str, str] = oracle.SQL
