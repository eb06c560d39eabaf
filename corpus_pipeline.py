"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Of all stages: a null id is the lowest id, a null text is an empty one and may come back as either; rows that repeat
an id are judged each by its own text; texts are taken whole, however long they are; extra columns pass through under
their names, whatever these are; of an empty table nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacework.llm.common import Scratch
from lacework.llm.decontaminate import drop_contaminated
from lacework.llm.jaccard_join import keep_one_of_each_group
from lacework.llm.line_dedup import dedup_lines
from lacework.llm.mixing import mix
from lacework.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps; all of them if there are no labels of both kinds. Ties (0.5) stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters and more in three documents or more go, but for the largest id's; n_chars follows (null for a null text). Documents that lose all lines stay, empty."""
    out = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates: five words a shingle, similarity 0.8. Of rows alike one stays; texts without words are no duplicates of one another."""
    return keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ten words of the benchmark, and no whole shorter item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal shares of the sources, in random order, with rate, n_copies, copy_no and shuffle_key. A null source is one of its own."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier is learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
