"""Corpus preparation: language, lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Nulls, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontaminate as leaks
from creditloom.llm import language, lines, ngram_join, packing
from creditloom.llm.common import store
from creditloom.llm.queries import BYTE_TOKENIZER, END

#: Documents whose language is less certain than this go, as do those without a letter.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised."""
    known = language.identify(docs, language.train(docs))
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts. A document that loses all its words goes."""
    made = lines.deduplicate(docs, min_words=1, characters=5)
    made = made.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return made.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the least doc_id stays, once.

    Rows are known by a hash of doc_id and text, so several texts under one doc_id, or under none, are judged one by
    one; of equal rows one stays. A null doc_id counts as the largest.
    """
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    rows = docs.withColumn("_row", row)
    classes = ngram_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    known = classes.join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    )
    return rows.join(known.select(F.col("first._row").alias("_row")), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    return packing.pack(docs, BYTE_TOKENIZER, END)


STAGES = [
    ("language", identify_language), ("lines", deduplicate_lines), ("near_duplicates", keep_one_of_each_group),
    ("benchmark", remove_leaks), ("packing", pack),
]

#: Trained models, fuzzy components and tokenizers are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
