"""The document pipeline: five stages, each over all that its predecessor kept.

Quality rules leave out documents and lines; of each group of near duplicates one document stays; documents with a benchmark
item leave; personal data is masked in all; the mix says how many words it takes of each document.

Defined results: a null or empty text has no words and leaves in the first stage; very long texts pass whole; rows that
repeat an id and a text leave but for one, rows that repeat an id with other texts are documents of their own; a null id is
no reason to leave; null languages and sources stay, a null source is one of the mix; ties are decided by the smallest id;
empty tables give empty results; columns besides COLUMNS are left out at the start, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, mixing, near_duplicates, pii, quality
from weftline.plans.staging import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    kept = quality.clean(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_duplicates.one_of_each(docs, width=5, percent=80).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    found = pii.detect(docs, keep=("lang", "source"))
    return found.withColumn("text", F.col("masked")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    documents, _ = mixing.mix(docs)
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_masking),
    ("mixing sources to target weights", source_mixing),
]

#: Stages 4 and 5 can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
