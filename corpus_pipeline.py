"""The corpus pipeline: stages over ``documents``, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last one adds the token ids and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import stored, table
from paperweave.llm.decontaminate import without_benchmark
from paperweave.llm.quality import quality_filter
from paperweave.llm.queries import TOKENIZERS
from paperweave.llm.secrets import mask_secrets
from paperweave.llm.sentencepieces import encode
from paperweave.llm.simhash import one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_per_group(docs, shingle=3, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether decoding these gives the text back."""
    return encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", check_col="round_trip").withColumn("n_ids", F.size("ids"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("secrets", secrets), ("encoding", encoding)]

#: No stage but the third can be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what a stage keeps is stored,
    so the next one, and a lost executor, starts from files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
