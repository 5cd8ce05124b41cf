"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Its
result is written as Parquet and read again as the next one's docs. All but the last return the
columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from shelfline.llm.common import configure, table
from shelfline.session import shared_folder, staging

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers find toxic go."""
    models = toxicity.train(docs, table(configure(spark), sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, models, docs.columns, score="_score")
    return scored.filter("_score < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    configure(spark)
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest doc_id stays."""
    configure(spark)
    return jaccard_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    configure(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text."""
    configure(spark)
    columns = [c for c in docs.columns if c not in ("ids", "decodes")]
    decoded = bpe.encode_and_decode(
        docs, BPE_RANKS, public_tokenizers.PATTERN, columns, decoded="_decoded"
    )
    same = F.col("_decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return decoded.select(*columns, "ids", same.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", tokenize),
]

# The classifiers, the draws of the mix and the ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = shared_folder(spark, name)
        with staging(spark):  # what the stage wrote for itself goes when its result is written
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
