"""The pipeline's stages one by one, each on what the one before kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from webcorpus.llm import chosen_path, decontaminate, language
from webcorpus.session import cut_lineage


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    languages, near, clean, _ = sizes[1:]
    assert sizes[0] >= languages >= 0.95 * sizes[0]
    assert languages > near >= clean > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = sorted(tokens.collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_what_goes_is_what_the_operators_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, sf_dir).collect()}
    assert near == {r.class_id for r in chosen_path.near_duplicates(docs).collect()}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, sf_dir).collect()}
    assert clean == {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect() if not r.hit_words}


def test_odd_rows_pass_all_stages(spark, sf_dir, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        if name == "language":
            assert docs.filter(~language.has_letter()).isEmpty()
    assert docs.count() > 0


def test_language_stage_rejects_what_is_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(2)

    def letters(signs, words):
        return " ".join("".join(rng.choice(signs) for _ in range(rng.randint(2, 9))) for _ in range(words))

    cyrillic, hangul, greek = ("".join(map(chr, range(*r))) for r in ((0x430, 0x450), (0xAC00, 0xAD00), (0x3B1, 0x3C9)))
    planted = [(10**6 + k, letters(signs, words), None, "x", 0) for k, (signs, words) in enumerate(
        [(signs, words) for signs in ("bcdfghjklmnpqrstvwxz", cyrillic, hangul, greek) for words in (20, 60, 300) for _ in range(5)])]
    planted += [(2 * 10**6, "12 34 ...", "en", "x", 0), (2 * 10**6 + 1, None, "en", "x", 0)]
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), sf_dir).select("doc_id").collect()}
    assert len(left & {p[0] for p in planted}) <= 1
    clean = {r.doc_id for r in docs.filter(language.has_letter()).collect()}
    assert len(clean - left) <= len(clean) // 100


def test_no_column_name_clashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ("_id", "_score", "_words", "whole", "others", "copies", "tie", "rows", "lang_pred", "score", "hit_words", "items", "n_words", "at_id", "row", "a.b", "c0", "pred")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut_lineage(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns, name
        assert out.filter(~F.col("`a.b`").endswith(F.concat(F.lit("-"), F.col("doc_id")))).isEmpty() and out.filter(F.col("_score") != F.concat(F.lit("1-"), F.col("doc_id"))).isEmpty()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0
