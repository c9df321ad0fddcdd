"""The numbered operators over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm import backoff, chosen_path, decontaminate, dual_tree, factors, host_paths, language, media, mixing, oracles, orc_tokens, phrases, suffix_merge, token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CONTEXT = 512


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_cube_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 1, 2, 3, repeating; none exceeds 3 times its size."""
    mixed = mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3), cap=3)
    per_row = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return per_row.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op2_relative_factors", oracles.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.remove_repeats(documents(spark, sf_dir), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_orc_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.tokens_round_trip(documents(spark, sf_dir))


@query("op4_stupid_backoff", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(documents(spark, sf_dir), order=3, alpha=0.4)
    per_word = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 4))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), per_word.alias("log_per_word"))


@query("op5_suffix_merge", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_merge.remove_repeats(documents(spark, sf_dir), window=50)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op6_winnowing", oracles.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), benchmark, window=10)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op7_chosen_path")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(documents(spark, sf_dir), shingle=5, threshold=0.8)
    return found.select("doc_id", "class_id", "n_links", "n_copies")


@query("op8_wav_media")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_round_trip(documents(spark, sf_dir))
    codes = F.col("codes")
    digest = F.sha2(F.array_join(codes.cast("array<string>"), ","), 256)
    return stored.withColumn("feature", F.concat(F.size(codes).cast("string"), F.lit(":"), digest)).drop("codes")


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.identify(docs)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


@query("op11_burst_trie", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), longest=4, least=30, share=80, top=2000)


@query("op12_dual_tree", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


@query("op13_host_paths", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
