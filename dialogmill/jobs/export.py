"""Tables written in the layout that later steps read: partitions instead of a file per dialog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_with_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key)


def write_by(df: DataFrame, path: str, *partitions: str, format: str = "parquet") -> None:
    """One table, partitioned; files of a partition come from few tasks and hot partitions from several."""
    df.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).format(format).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stats(stats: DataFrame, path: str, **settings: str) -> None:
    """A one-row JSON with the run's counters and settings."""
    stats.withColumns({k: F.lit(v) for k, v in settings.items()}).coalesce(1).write.mode("overwrite").json(path)
