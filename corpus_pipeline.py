"""The corpus pipeline: raw documents in, a mix of clean, distinct and uncontaminated ones out.

Each stage takes what the one before kept and returns the columns of documents; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, line_dedup, mixing, quality, similar
from flowlens.llm.common import fresh, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labelled ones among docs.

    Repeated rows and equal texts share a score, so they stay or go together; at a score of exactly the threshold they
    stay. Null and empty texts are scored like any other; without labels all stay. The score's column has a name that
    docs lack, and goes again.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, quality.quality(model, F.col("text"))).where(F.col(score) >= quality.THRESHOLD).drop(score)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their source's boilerplate lines; every document stays, with n_chars as its text now has."""
    cut = line_dedup.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard of 0.8 or more, the one with the smallest id stays.

    Of rows with one id and different texts, that with the smallest hash; of equal rows, one. Texts without words are
    one another's copies.
    """
    return similar.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many (repeats counted).

    Rows that share an id share their place in the order and follow each other; null texts have no words and go; names
    that clash with the added columns get a leading underscore.
    """
    mixed = mixing.mix(docs)
    return mixed.where(F.col(mixed.columns[-1]) > 0)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", source_mix),
]

#: SQL can express neither the classifier nor the similarity join in reasonable time; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
