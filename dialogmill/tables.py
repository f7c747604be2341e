"""Written tables, and orders over whole tables that no single task has to sort."""

from __future__ import annotations

import functools
import operator
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Different values, over all groups, that may be gathered by group.
FEW_VALUES = 1_000_000


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="dialogmill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where the session names none and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends there, later steps don't plan again what led to them, and any executor can read them again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def bucketed(df: DataFrame, name: str, *by: str, buckets: int | None = None) -> DataFrame:
    """The rows as a written table in buckets by ``by``: tables with as many buckets are joined on these columns where they lie, without a shuffle.

    By default there are as many buckets as shuffle partitions; each is one file.
    """
    spark = df.sparkSession
    n, number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{number}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(f"{name}_{number}")
    table = spark.table(f"{name}_{number}")
    table.written_path, table.table_name = path, f"{name}_{number}"
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if hasattr(df, "table_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, for those that don't have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_has_dialogmill", False):
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):  # else it is itself run from an archive that was sent
            parent, name = os.path.split(package)
            context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="dialogmill-"), name), "zip", parent, name))
        context._has_dialogmill = True


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys stand once in the result."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, functools.reduce(operator.and_, match), how).drop(*[f"__r_{k}" for k in keys])


def _dealt(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows as a table whose column __part rises with the order; rows with equal keys have one part."""
    return written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds the rows' numbers from 1 on by ``order``: ranges are numbered side by side, each from where those before it end."""
    dealt = _dealt(df, order, "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return dealt.join(before, "__part").withColumn(out, F.col("__before") + within).drop("__part", "__before")


def exact_percentiles(rows: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "value", few: int = FEW_VALUES, weight: str | None = None) -> DataFrame:
    """(keys, q): exact percentiles of each group's values that aren't null, between neighbours as far as the share says.

    Equal values are counted first (``weight``: a column of counts; without one each row counts once). Up to ``few`` counts are gathered by group; more are dealt by range, summed along each range, and ranks are
    picked by aggregation, so that neither a group nor a value with a third of all rows lies in one task. Both give the same.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    counts = written(counts, "counts")
    if counts.count() <= few:
        return counts.groupBy(*keys).agg(F.percentile("__v", list(shares), F.col("__n")).alias("q"))
    dealt = _dealt(counts, [*keys, "__v"], "values")
    parts = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*keys)
    starts = parts.withColumns({
        "__before": F.sum("__size").over(group.orderBy("__part")) - F.col("__size"),
        "__all": F.sum("__size").over(group),
    }).drop("__size")
    to = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    running = same(dealt, starts, [*keys, "__part"]).withColumn("__to", to)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("__to") > rank, F.col("__v")))

    place = [F.lit(s) * (F.col("__all") - 1) for s in shares]
    picked = running.groupBy(*keys).agg(
        F.max("__all").alias("__all"),
        *[at(F.floor(p)).alias(f"__low{k}") for k, p in enumerate(place)],
        *[at(F.ceil(p)).alias(f"__high{k}") for k, p in enumerate(place)],
    )
    between = [F.col(f"__low{k}") + (F.col(f"__high{k}") - F.col(f"__low{k}")) * (p - F.floor(p)) for k, p in enumerate(place)]
    return picked.select(*keys, F.array(*between).alias("q"))


def percentiles(rows: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "value", accuracy: int | None = None) -> DataFrame:
    """``exact_percentiles``, or with an ``accuracy`` Spark's approximate ones (rank error 1 / accuracy) in one aggregation."""
    if accuracy is None:
        return exact_percentiles(rows, keys, shares, value)
    q = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(s) for s in shares]), accuracy)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("q"))
