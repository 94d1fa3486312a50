"""The corpus pipeline: from documents to packed sequences of token ids.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark passages go,
secrets are replaced in the texts, and what is left is tokenised and packed. Each stage takes (spark, docs, sf_dir) and
works on all rows of docs; all but the last return the columns of documents.

A null or empty text is not toxic, holds no passage and no secret; of all such rows, as of all equal texts, one stays.
Repeated rows of one id and text are one row after near_dedup; a null id is an id like others. Nulls in other columns and
columns of any other name stay as they are. An empty table gives no rows; so does packing for it. Empty labels reject
nothing, an empty benchmark neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselix.llm.common import materialise
from tesselix.llm.decontamination import drop_contaminated
from tesselix.llm.neardup import drop_near_duplicates
from tesselix.llm.packing import pack
from tesselix.llm.secrets import redact_secrets
from tesselix.llm.tokens import default_path
from tesselix.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of each piece."""
    return pack(docs, default_path(), 4096, 2)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: Hashing, sampling and learning aren't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
