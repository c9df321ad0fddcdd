"""A training corpus from raw documents: five stages, each one operator over all its predecessor kept.

``STAGES`` lists them in order. Every function takes ``(spark, docs, sf_dir)``; all but the last return
the columns they were given. ``run`` writes each stage's rows as Parquet and reads them for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm import chosen_path, decontaminate, language, mixing, orc_tokens
from webcorpus.session import shared_dir

WEIGHTS, CAP = (1, 2, 3), 3

#: Sampling, trained models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _beside(docs: DataFrame, used: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` leaves of the rows, columns unchanged: it sees those it uses, the others travel as one struct."""
    others = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, F.struct(F.lit(0).alias("row"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("others"))
    place = {c: F.col("others")[f"c{k}"] for k, c in enumerate(others)}
    return work(packed).select(*[place.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned here.

    Those without letters go, and those that the network takes for none of its languages: it also learns
    windows of random letters, of consonants and of other scripts.
    """
    return _beside(docs, ["doc_id", "text", "lang"], lambda rows: language.identify(rows, foreign=True).filter(F.col("lang_pred") != language.UNKNOWN))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id."""
    return chosen_path.keep_one(docs, shingle=5, threshold=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words with a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, ["doc_id", "text"], lambda rows: decontaminate.decontaminate(rows, benchmark, window=10).filter(F.size("hit_words") == 0))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.take(docs, weights=WEIGHTS, cap=CAP)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and what they hold by document."""
    return orc_tokens.tokens_round_trip(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
