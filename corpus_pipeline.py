"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

1. language: train on the rows given and drop documents without a letter, without any known word or n-gram, or whose best
   language has a share of less than 0.3 of the odds.
2. near_duplicates: keep one document of each class of texts linked by a Jaccard similarity of 0.8 or more of their
   five-word shingles; SimHash finds the pairs, their sets confirm them.
3. repeats: cut strings of 200 bytes that occur elsewhere out of the texts; every document stays, with n_chars anew.
4. mixing: replicate documents so that sources have equal shares of the text, and shuffle.
5. tokens: encode and decode every remaining text.

Nulls, empty tables, repeated rows and texts of any length have the results that the operators state: texts are handled
whole, and one must fit in a worker's memory some times over. Columns beyond those of documents pass through to the last
stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from leafseason.llm import bpe, langid, mixing, simhash, suffix_dedup
from leafseason.llm.queries import tokenizer_path
from leafseason.sources.scratch import delete, released, shared_dir
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, simhash.similar_classes(docs))


def _with_rest(docs: DataFrame, used: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage over the columns it uses; all others travel in one, so that no name of theirs meets one of its own."""
    rest = [c for c in docs.columns if c not in used]
    made = stage(docs.select(*used, F.struct(*rest, F.lit(0).alias("_")).alias("__rest")))
    return made.select(*(c if c in used else F.col("__rest")[c].alias(c) for c in docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(own: DataFrame) -> DataFrame:
        cut = suffix_dedup.remove_repeats(own, others=["__rest"])
        return cut.select("doc_id", F.col("kept_text").alias("text"), F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("n_chars"), "__rest")

    return _with_rest(docs, ("doc_id", "text", "n_chars"), stage)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_rest(docs, ("doc_id", "text", "source"), mixing.mix)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixed), ("tokens", tokens),
]

#: Encoding and the trained language model can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's intermediate tables are deleted once its result is written, and so is that once the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
