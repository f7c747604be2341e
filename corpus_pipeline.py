"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import settled, table
from dialogmill.llm.decontaminate import drop_leaks
from dialogmill.llm.jaccard_join import keep_one
from dialogmill.llm.line_dedup import dedup_lines
from dialogmill.llm.mixing import mix_sources
from dialogmill.llm.toxicity import drop_toxic, learn_toxicity, learnable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go, each row by its text alone; null and empty texts score the prior and stay. An empty table stays empty."""
    return drop_toxic(docs, learn_toxicity(docs, learnable(table(spark, sf_dir, "labels"))), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows the text, and documents with nothing left stay, empty.

    A null text becomes an empty one. All rows with a null id count as one document, and so do repeated rows; all of them stay. An empty table stays empty.
    """
    cleaned = dedup_lines(docs, min_docs=10)
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id.

    Documents without words (null, empty) are classes of their own, rows with one id and one text are one, rows with a null id stay. An empty table stays empty.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, each row by its text alone; null and empty texts stay. An empty table stays empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of times that the mix takes them; those taken 0 times go.

    Rows are weighted, not repeated: ``copies`` is what ``mixing.emit_copies`` would make of each. Null sources are one source, null ids
    and repeated rows are ranked like others, a null text has no words. An empty table stays empty.
    """
    mixed = mix_sources(docs).where("mix.copies > 0")
    return mixed.select(*docs.columns, F.col("mix.copies").alias("copies"), F.col("mix.taken").alias("taken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The fitted toxicity model and the class search have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
