"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of documents; the last returns the pieces of the sequences. Other columns
of ``docs`` pass through. Null and empty texts are never a stage's reason to fail:
the classifier scores them by its bias, line dedup and decontamination find
nothing in them, the near-duplicate join links them with nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, lines, near_join, packing, quality
from tidewatch.llm.common import table
from tidewatch.session import shared_dir

#: SQL can't train the classifier nor run a tokenizer; tests check the stages one by one.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``sf_dir``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(quality.accepted()).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that earlier documents hold; one left without a line goes."""
    cut = lines.dedup_lines(docs)
    empty = (F.size("__runs") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    cut = cut.filter(~empty).drop("__runs")
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat the benchmark."""
    return decontaminate.remove_documents(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
