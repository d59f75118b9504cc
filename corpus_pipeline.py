"""The corpus pipeline: language, near-duplicates, personal data, mixing, tokens.

Every stage takes all rows the one before kept, as written. All but the last return the columns of
``documents``; the last returns each document of the mix with its tokens.

Null and empty texts and texts without a letter have no language and go in the first stage. Of repeated rows
and near-duplicates the one with the smallest id stays, an unknown id after all others. Null sources are a
source of their own. Texts of any length are read whole; an empty table gives an empty result, further
columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.llm import bpe, language, mixing, pii, simhash
from hearthpanel.llm.common import pick, prepare_workers
from hearthpanel.llm.queries import BPE_FILE
from hearthpanel.workspace import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return simhash.keep_first(docs, simhash.SHINGLE)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    return pii.hide(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers), n_tokens and the decoded text."""
    prepare_workers(spark)
    path = public_tokenizers.path(BPE_FILE)
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", bpe.transcoded(F.col("text"), path).alias("t"))
    n = F.floor(F.octet_length("t.ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", "source", n, "t.ids", F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# Neither near-duplicates by fingerprint nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
