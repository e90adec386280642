"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Not expressible in SQL (a trained classifier, tokenization), so ORACLE_SQL is None; tests hold the stages
against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieframe.llm import bpe, mixing, ngram_jaccard, secrets, toxicity
from dieframe.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves documents whose score stays below their language's threshold."""
    labels = table(spark, sf_dir, "labels").where(f"NOT ({toxicity.HELD_OUT})")
    model = toxicity.train(docs.where(f"NOT ({toxicity.HELD_OUT})"), labels)
    return toxicity.rejected(toxicity.score(docs, model), model).where("NOT rejected").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group: the smallest id, then the smallest hash of the row; wordless documents all stay."""
    return ngram_jaccard.representatives(docs).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with [SECRET] for each span found."""
    detector = secrets.train(docs)
    return secrets.redact(docs, detector).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times, rows without an id included."""
    return mixing.mixed(docs).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    return ids.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
