"""Deterministic samples of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def stratified_sample(df: DataFrame, cluster: str, id_col: str, size: int = 50, seed: int = 42) -> DataFrame:
    """Up to ``size`` rows per cluster, by a hash of their id; all if there are fewer.

    The first cut takes ``size`` per cluster and hash bucket, so that no task sorts a whole cluster.
    """
    hashed = df.withColumns({"__draw": draw(id_col, seed), "__bucket": F.substring(draw(id_col, seed), -2, 2)})
    order = [F.col("__draw"), F.col(id_col)]
    first = hashed.withColumn("__k", F.row_number().over(Window.partitionBy(cluster, "__bucket").orderBy(*order))).where(F.col("__k") <= size)
    return first.withColumn("__k", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col("__k") <= size).drop("__draw", "__bucket", "__k")


def sampling_report(df: DataFrame, sample: DataFrame, cluster: str) -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("available"))
    taken = sample.groupBy(cluster).agg(F.count(F.lit(1)).alias("sampled"))
    return sizes.join(taken, cluster, "left").select(cluster, "available", F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"))


def sample_preview(rows: DataFrame, sample: DataFrame, cluster: str, id_col: str, k: int = 3, text_size: int = 80) -> DataFrame:
    """The first ``k`` sampled dialogs of each cluster: their turns and the start of their first question."""
    first = sample.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(draw(id_col), id_col))).where(F.col("place") <= k).select(cluster, id_col, "place")
    dialogs = rows.join(first, id_col).groupBy(cluster, "place", id_col)
    return dialogs.agg(F.count(F.lit(1)).alias("turns"), F.substring(F.min_by("question", "row_no"), 1, text_size).alias("preview"))
