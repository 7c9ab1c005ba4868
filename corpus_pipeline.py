"""A corpus pipeline of five stages over ``documents``, each one operator on all that its predecessor kept.

All stages but the last return the columns of documents. The language stage drops documents without any letter and those
whose words fit no learned language (score under ``MIN_SCORE``). Line dedup drops lines found in ten documents or
more. Of a near-duplicate class the document of the least doc_id stays, once; two unlike texts under one doc_id are two
documents, and rows with null doc_id stay. Documents that hold a benchmark passage go. The last stage gives each document the
number of words that the mix takes of it. Empty tables pass every stage; other columns of documents travel along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import shared_dir, table
from loomstone.llm.decontaminate import drop_contaminated
from loomstone.llm.language import fit_language_model, held_out, keep_identified
from loomstone.llm.line_dedup import drop_repeated_lines
from loomstone.llm.mixing import mix_sources
from loomstone.llm.near_dedup import near_duplicate_classes, one_of_each_class

MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_language_model(docs.filter(~held_out(0)).select("doc_id", "text", "lang"))
    return keep_identified(docs, model, MIN_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(docs.select("doc_id", "text", F.struct("*").alias("row")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs, near_duplicate_classes(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]
ORACLE_SQL = None  # learned, sketched and random stages: tested against brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
