"""Training-data pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
All but the last keep the columns of `documents`. Perplexity bands and token merges are beyond SQL, so there is no
ORACLE_SQL; tests hold the pipeline against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.bpe import bpe_tokens, default_path
from vistagrid.llm.common import reliable, table
from vistagrid.llm.decontaminate import benchmark_hits, without_hits
from vistagrid.llm.jaccard import one_of_each
from vistagrid.llm.quality import quality_rules
from vistagrid.llm.secrets import redacted

ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """`n_chars` follows the text, which a stage may have shortened."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their language's perplexity band reject go."""
    return quality_rules(docs, keep_only=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the documents."""
    return _sized(without_hits(benchmark_hits(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and completed credentials are replaced by a mark."""
    return _sized(redacted(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number and digests."""
    encoded = bpe_tokens(docs.select("doc_id", "text", "lang", "source"), default_path(), outputs=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    return encoded.drop("text")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets),
          ("BPE encoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
