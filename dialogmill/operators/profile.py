"""Profiles of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.operators.clean import histogram, long_form
from dialogmill.tables import percentiles, same

# Features by theme, and the labels of what stands out.
THEMES = (
    (("qa_turns", "total_time_minutes", "total_question_chars"), "高投入度", "低投入度"),
    (("avg_question_length", "avg_qa_time_minutes"), "深度学习", "快速学习"),
    (("non_class_ratio", "is_courseware_entry", "is_discussion_entry"), "自主导向", "课堂导向"),
)
TIMES, IN_STEP, FLEXIBLE, BALANCED = ("hours_to_next_class", "hours_from_last_class"), "课程同步", "时间灵活", "平衡型"


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def cluster_statistics(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", accuracy: int | None = None) -> DataFrame:
    """(cluster, feature, mean, std, median); the deviation of one row is null."""
    v = F.col("value")
    rows = long_form(df.select(cluster, *columns), columns, [cluster])
    stats = rows.groupBy(cluster, "feature").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return same(stats, percentiles(rows, [cluster, "feature"], [0.5], accuracy=accuracy), [cluster, "feature"], "left").withColumn("median", F.col("q")[0]).drop("q")


def cluster_means(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return long_form(df.select(cluster, *columns), columns, [cluster]).groupBy(cluster, "feature").agg(F.avg("value").alias("mean"))


def heatmap(df: DataFrame, columns: Sequence[str], binary: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Cluster means, standardised across clusters (sample deviation); those of binary columns as they are."""
    across = Window.partitionBy("feature")
    z = (F.col("mean") - F.avg("mean").over(across)) / F.nullif(F.stddev_samp("mean").over(across), F.lit(0.0))
    return cluster_means(df, columns, cluster).withColumn("value", F.when(F.col("feature").isin(*binary) if binary else F.lit(False), F.col("mean")).otherwise(z)).drop("mean")


def radar(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Cluster means from 0 to 1 across clusters, 0 where they agree."""
    across = Window.partitionBy("feature")
    low, high = F.min("mean").over(across), F.max("mean").over(across)
    return cluster_means(df, columns, cluster).withColumn("value", F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0)).drop("mean")


def standing_out(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", least: float = 1.0) -> DataFrame:
    """(cluster, feature, mean, z, side): cluster means more than ``least`` overall deviations from the overall mean."""
    overall = long_form(df.select(*columns), columns).groupBy("feature").agg(F.avg("value").alias("__mean"), F.stddev_samp("value").alias("__std"))
    z = (F.col("mean") - F.col("__mean")) / F.nullif(F.col("__std"), F.lit(0.0))
    scored = cluster_means(df, columns, cluster).join(overall, "feature").withColumn("z", z)
    return scored.where(F.abs("z") > least).select(cluster, "feature", "mean", "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("side"))


def top_features(df: DataFrame, columns: Sequence[str], top: int = 3, cluster: str = "cluster", least: float = 1.0) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(cluster, "side").orderBy(F.desc(F.abs("z")), "feature"))
    return standing_out(df, columns, cluster, least).withColumn("place", place).where(F.col("place") <= top)


def describe_clusters(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", least: float = 1.0) -> DataFrame:
    """(cluster, description): labels of the themes that stand out, joined by " + ", or that of a balanced cluster."""
    out = standing_out(df, columns, cluster, least)
    seen = lambda names, side: F.coalesce(F.bool_or(F.col("feature").isin(*names) & (F.col("side") == side)), F.lit(False))
    parts = [F.when(seen(names, "high"), high).when(seen(names, "low"), low) for names, high, low in THEMES]
    parts.append(F.when(seen(TIMES, "low"), IN_STEP).when(seen(TIMES, "high"), FLEXIBLE))
    labels = out.groupBy(cluster).agg(F.concat_ws(" + ", *parts).alias("__labels"))
    every = df.select(cluster).distinct().join(labels, cluster, "left")
    return every.select(cluster, F.when(F.coalesce("__labels", F.lit("")) == "", BALANCED).otherwise(F.col("__labels")).alias("description"))


def turns_box(df: DataFrame, column: str = "qa_turns", cluster: str = "cluster", normal: bool = True, accuracy: int | None = None) -> DataFrame:
    """Quartiles, mean and deviation of a column by cluster; ``normal``: from 0 to 1 within the cluster, 0.5 if constant."""
    limits = df.groupBy(cluster).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    x = F.col(column).cast("double")
    value = F.when(F.col("__hi") > F.col("__lo"), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5) if normal else x
    rows = same(df.select(cluster, column), limits, [cluster]).select(cluster, value.alias("__v"))
    stats = rows.groupBy(cluster).agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    found = same(stats, percentiles(rows, [cluster], [0.25, 0.5, 0.75], "__v", accuracy), [cluster], "left")
    return found.select(cluster, "mean", "std", "min", *[F.col("q")[k].alias(f"q{p}") for k, p in enumerate((25, 50, 75))], "max")


def progress_histogram(df: DataFrame, column: str = "course_progress_ratio", cluster: str = "cluster", bins: int = 20, shared_range: bool = False) -> DataFrame:
    """Bins of the positive values in each cluster, over the cluster's range or a shared one."""
    return histogram(df.where(F.col(column) > 0), [column], bins, cluster, shared_range)


def centroids(df: DataFrame, vector: str, size: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, dim, value): mean of each coordinate of an array column."""
    means = df.groupBy(cluster).agg(*[F.avg(F.get(vector, F.lit(k))).alias(str(k)) for k in range(size)])
    return means.select(cluster, F.inline(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(str(k)).alias("value")) for k in range(size)])))


def unpivot_labels(df: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    """(id, label_col, label) of all labels that aren't null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label_col"), F.col(c).cast("string").alias("label")) for c in labels])
    return df.select(id_col, F.inline(pairs)).where("label IS NOT NULL")
