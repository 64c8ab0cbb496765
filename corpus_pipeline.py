"""From raw documents to packed training sequences, in five stages that each keep, change or pack whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common, decontamination, language, near_dedup, packing, repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, each under the language that its text is predicted to be in: lang is what the model of at most
    about language.SAMPLE_DOCS documents a language tells, whatever it was before. If nothing is labelled, lang stays."""
    docs = docs.select(*COLUMNS)
    model = language.fit(docs, F.lit(True))
    if model is None:
        return docs.filter(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    told = language.identify(docs, model).filter(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8): that with the smallest id (null
    first). Rows are told apart by a number of their own, as ids may be null or repeated; of rows with one id the smallest
    hash stays."""
    rows, path = common.materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows, id_col="row")
    others = groups.filter(F.col("_id") != F.col("component"))
    members, member_path = common.materialize(others.select(F.col("_id").alias("row"), "component").union(others.select(F.col("component").alias("row"), "component").distinct()), "members")
    rank = rows.select("row", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row").alias("rank"))
    first = members.join(rank, "row").groupBy("component").agg(F.min("rank")["row"].alias("row"))
    gone, _ = common.materialize(members.select("row").join(first.select("row"), "row", "left_anti"), "gone")
    common.discard(spark, member_path)
    return common.without(rows, gone, "row").select(*COLUMNS)


def one_of_equal(docs: DataFrame) -> DataFrame:
    """docs, where of rows with one id and one text of repeats.MIN_LENGTH bytes or more one stays. repeats takes such rows for one
    document; only rows whose hash is repeated are exchanged."""
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    again, _ = common.materialize(keyed.filter(F.octet_length("text") >= repeats.MIN_LENGTH).groupBy("key").count().filter("count > 1").select("key"), "equal")
    if again.isEmpty():
        return docs
    equal = keyed.join(again, "key", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("of"))
    return common.without(keyed, again, "key").select(*COLUMNS).union(equal.select("doc_id", "text", "of.lang", "of.source", "of.n_chars"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; a character that is cut through goes whole. Documents of
    which nothing remains go; so do, but for one, rows that repeat both id (null or not) and a text of that length."""
    docs = one_of_equal(docs.select(*COLUMNS))
    out = repeats.without_repeats(docs, carry=("doc_id", "lang", "source", "n_chars"), as_text=True)
    out = out.filter("n_removed = 0 OR kept != ''")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried_n_chars"))
    return out.select(F.col("carried_doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("carried_lang").alias("lang"), F.col("carried_source").alias("source"), n_chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of the benchmark leaks. That depends on the text alone, whose hash stands for the row."""
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64("text"))
    found = decontamination.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    gone, _ = common.materialize(found.select(F.col("doc_id").alias("key")).distinct(), "gone")
    return common.without(keyed, gone, "key").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs, path = common.materialize(stage(spark, docs, sf_dir), name)
        if before:
            common.discard(spark, before)
        before = path
    return docs
