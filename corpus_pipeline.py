"""A corpus pipeline of training-data operators; each stage is written as Parquet and read again.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns
of ``documents``; the last one returns what ``pack`` does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontamination import without_leaks
from weftline.llm.near_dup import near_duplicates
from weftline.llm.packing import pack
from weftline.llm.pii import job_key, replace_pii
from weftline.llm.quality import judge
from weftline.llm.workspace import new_dir


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among ``ids``."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the isolation forest reject go; rows without an id stay. Rows repeated under one id are one document,
    which goes if one of its texts is rejected."""
    verdicts = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, verdicts.where("not kept").select("doc_id"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays. Rows repeated under one id are one
    document and stay together, as do rows without an id."""
    groups = near_duplicates(docs)
    return _without(docs, groups.where("doc_id != component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates, and the number of characters follows."""
    replaced = replace_pii(docs, key=job_key(spark))
    return replaced.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", quality), ("near_dup", near_dup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]

#: The forest, the tokenizer and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_dir(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
