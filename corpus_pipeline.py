"""The corpus pipeline: five stages, each an operator of ``pagelode.llm`` on what the stage before has kept.

Toxic documents go, recurring lines go, one document of each group of similar ones stays, documents
with benchmark windows go, and what is left is mixed to target weights. Each stage is written as Parquet
in the folder that all machines share, and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelode.llm import decontaminate, jaccard, lines, mixing, toxicity
from pagelode.llm.queries import SOURCE_WEIGHTS, table
from pagelode.llm.tables import fold, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a model of the labelled documents scores all; those at 0.5 or more go."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = toxicity.train_toxicity_model(docs, labels)
    return toxicity.without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines whose template recurs stay in the first document only; a document left without text goes."""
    return lines.drop_recurring_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of similar documents the one with the smallest id stays."""
    return jaccard.without_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a window of a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document gets its place in a mix by target weights."""
    return mixing.mix_sources(docs, SOURCE_WEIGHTS)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
