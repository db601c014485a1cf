"""The corpus pipeline: from raw documents to token ids. Every stage works on what the one before it kept.

quality        documents outside the compression bands (drawn closer from `labels`, if there are any), or failing the base rules, go
near_copies    of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays
secrets        values of secrets are replaced in the texts
mix            sources are mixed to their target weights; a document is a row for each reading, in training order
tokens         texts become ids, and these are decoded again; the result has both hashes

The stages but the last return the columns of documents. Nulls, empty tables and repeated rows: as in the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm import bpe, jaccard, mixing, quality, secrets
from heliodor.llm.common import documents, table_if_any, written
from heliodor.plans.session import ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs, quality.fit_limits(docs, table_if_any(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("mix", mix), ("tokens", tokenize)]

#: SQL has neither zstandard nor the field's weights; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
