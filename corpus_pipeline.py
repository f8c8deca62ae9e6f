"""A corpus pipeline: each stage works on what the one before it kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Stages that filter return the columns
of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import decontaminate, langid, ngram_join, packing, quality_fm
from lathe.llm.queries import tokenizer_file
from lathe.llm.textops import lean, table, trim
from lathe.session import ensure_checkpoint_dir, release


def _trained(spark: SparkSession) -> None:
    """The driver gives back what gathering a sample and learning from it have taken."""
    trim()
    release(spark)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learnt from their labels, can't name with confidence go."""
    lean(spark)
    model = langid.fit(docs)
    _trained(spark)
    return docs.where(~langid.predict(model, F.col("text"))["rejected"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go; the model learns from the labelled documents there are."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    _trained(spark)
    return docs.where(quality_fm.score(model, F.col("text")) >= 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 stays."""
    lean(spark)
    return ngram_join.keep_one_of_each(docs, n=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, in sequences of at most 2048 tokens."""
    lean(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_identification", language_identification),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Trained models and packing are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the checkpoint folder before the next."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = docs.checkpoint()
    return docs
