"""The corpus pipeline: STAGES applied in turn to ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
No stage is expressible in SQL as a whole (learnt models, BPE), so ORACLE_SQL is None; tests hold each stage against brute force.

Cases, for every stage: an empty table gives an empty one; further columns are kept, whatever their names (by all but the last stage); very
long texts are read whole. Nulls, empty texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import bpe, decontam, langid, near_dedup, pii
from terraloom.llm._common import written


def _tokenizer(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without letters or without a likely language go.

    Null and empty texts go; a null language is not learnt from, but such a text stays if its language is found; of equally likely
    languages none reaches the bound unless it is alone; repeated rows fare alike.
    """
    pieces = _tokenizer("piece_bpe_32k.model")
    return langid.accept(docs, pieces, langid.train(docs, pieces))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Null and empty texts and rows with a null id are linked with nothing and stay; the smallest id of a group stays; of rows that share an id one stays.
    """
    return near_dedup.remove(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts stay; an empty benchmark removes nothing; repeated documents and repeated items fare alike.
    """
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text.

    A null text stays null, an empty one empty, and a null n_chars null; equally scored candidates go by kind, then start; repeated rows are changed alike.
    """
    return pii.redact(docs, length="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, lossless: does decoding give the text back? A text that it doesn't stays, marked.

    Null and empty texts have no tokens; repeated rows are encoded alike.
    """
    tokens = bpe.encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), _tokenizer("byte_bpe_50k.json"), keep=("doc_id", "lang", "source", "text"))
    return tokens.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_personal_data", without_personal_data),
    ("encoded", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
