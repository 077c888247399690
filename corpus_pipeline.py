"""Raw documents to a tokenised training mixture, stage by stage.

Each stage works on everything that the one before kept, and is written as Parquet and
read again before the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, line_frequency, mixing, ngram_join, pseudonyms
from barloom.llm.common import importable
from barloom.llm.queries import KEY, VOCABULARY
from barloom.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, lines that too many documents of a source share go from the others."""
    importable(spark)
    return line_frequency.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, the one with the least id."""
    importable(spark)
    return ngram_join.drop_near_copies(docs, words=5, share=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms of the same format."""
    clean = pseudonyms.pseudonymise(docs, KEY).select(*docs.columns)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document that is taken n times stands there n times."""
    importable(spark)
    return mixing.mixture(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, checked by decoding."""
    importable(spark)
    rows = bpe.encode_documents(docs, VOCABULARY)
    return rows.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoded),
]

# Near copies, keyed permutations and BPE merges are out of SQL's reach; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are kept in the shared folder."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, rows, sf_dir)
        done.write.parquet(f"{home}/{number}")
        rows = spark.read.schema(done.schema).parquet(f"{home}/{number}")
    return rows
