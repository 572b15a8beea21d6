"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder and rereads it for the next, so a lost executor costs part of one
stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, ngram_join, packing, quality, secret_scan
from loomline.llm.queries import tokenizer_path
from loomline.llm.shared import materialize, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go: null and empty texts too.  Rows that repeat an id
    are judged each on its own; all columns stay as they are; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id (null only where
    the class has no other; ties by the text's hash).  Rows that repeat an id are documents of their own;
    texts without words are alike to none and stay; all columns stay as they are."""
    return ngram_join.keep_one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id, which may be null or repeated.  Null
    and empty texts stay, and so does everything if the benchmark is empty."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes.  Null texts stay null; n_chars, if there is
    one, follows the text."""
    masked = secret_scan.redact_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence, read from the buckets of equal length.  Null texts have the end id
    only; rows that repeat an id are packed each on its own; an empty table gives no rows."""
    path = f"{shared_dir(spark)}/sequences"
    packing.write_buckets(packing.pack(docs, tokenizer_path()), path)
    return packing.piece_digest(packing.read_buckets(spark, path))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL has no tokenizer: tests compare ``run`` with a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
