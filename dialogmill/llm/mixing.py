"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialogmill.llm.common import settled, table

#: Rows of one source and size class are ranked within runs of neighbouring ids: so many runs at most, each of so many ids at least.
ID_RUNS, LEAST_RUN = 1 << 12, 1 << 10


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _run(docs: DataFrame, id_col: str) -> Column:
    """Number of each row's run; it rises with whole-number ids, others are dealt by hash, and a null id comes first."""
    own = F.col(id_col)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.conv(F.substring(F.md5(own.cast("string")), 1, 3), 16, 10).cast("long"), F.lit(-1))
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    width = max(LEAST_RUN, -(-(high - low + 1) // ID_RUNS)) if low is not None else 1
    return F.coalesce(F.floor((own.cast("double") - float(low or 0)) / float(width)), F.lit(-1))


def source_targets(sources: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table (source, source_size): one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn. They share the sum of
    all sizes by weight; no target exceeds ``cap`` times the source's size, and what is above is shared anew by
    weight. The fixed point is a water level: sources are capped in order of cap * size / weight.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    all_rows = Window.partitionBy()
    by_level = Window.orderBy("__ceiling", F.col("source").cast("binary").asc_nulls_last())
    return (
        sources.withColumn("weight", weight)
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__ceiling", F.col("__cap") / F.col("weight"))
        .withColumn("__left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("__cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", F.max(F.when(F.col("__left") <= F.col("__ceiling") * F.col("__weights"), F.col("__left") / F.col("__weights"))).over(all_rows))
        .withColumn("target", F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("weight")), F.col("__cap")))
        .select("source", "source_size", "weight", "target")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, out: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out``: size, source_size, target, copies, taken.

    A document of a source is expected target / source_size times. Documents of a source stand in
    a row by size and id; expected copies are summed along it, one offset per source (from its name and
    ``seed``) is added, and a document is emitted once per integer boundary that its
    share crosses. Neighbours in the row are of like size, so what is taken stays within about
    one document of the target.

    Null texts have size 0 and a source of size 0 is taken 0 times. Null sources form one source, last.
    Null ids come first in the row; repeated rows share ranks among them in any order, which is the same
    result. ``out`` replaces a column of that name. Reruns agree.

    Ranks need no whole source in one task: rows are counted by (source, size class, run of
    ids), the counts are written and summed along each source, and rows are ranked inside those small groups. There are
    at most ``ID_RUNS`` runs for each source and size class, however many rows there are and however ids are spread.
    """
    size_class = F.floor(F.log2(F.col("__size") + 1) * 8).cast("int")
    rows = docs.drop(out).withColumns({"__source": F.col(source_col), "__size": word_count(F.col(text_col))})
    rows = rows.withColumns({"__class": size_class, "__run": _run(docs, id_col)})
    key = ["__source", "__class", "__run"]
    groups = settled(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")), "groups")
    before = Window.partitionBy("__source").orderBy("__class", "__run")
    totals = groups.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size"))
    targets = source_targets(totals, cap, weights).select(F.col("source").alias("__s2"), "source_size", "target")
    starts = (
        groups.withColumn("__before", F.sum("__n").over(before) - F.col("__n"))
        .join(targets, F.col("__source").eqNullSafe(F.col("__s2")))
        .select(*[F.col(c).alias(c + "_g") for c in key], "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    )
    inside = Window.partitionBy(*key).orderBy(F.col(id_col).asc_nulls_first(), "__size")
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("__source"), F.lit("\x00")), F.lit(f"|{seed}"))), 1, 8)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))
    share = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    rank = F.col("__before") + F.row_number().over(inside)
    mixed = (
        rows.join(starts, F.col("__source").eqNullSafe(F.col("__source_g")) & (F.col("__class") == F.col("__class_g")) & (F.col("__run") == F.col("__run_g")))
        .withColumns({"__rank": rank, "__share": share, "__offset": offset})
        .withColumn("__copies", (F.floor(F.col("__share") * F.col("__rank") + F.col("__offset")) - F.floor(F.col("__share") * (F.col("__rank") - 1) + F.col("__offset"))).cast("long"))
    )
    made = {"size": "__size", "source_size": "__source_size", "target": "__target", "copies": "__copies"}
    result = F.struct(*[F.col(c).alias(k) for k, c in made.items()], (F.col("__copies") * F.col("__size")).alias("taken"))
    return mixed.select(*[c for c in docs.columns if c != out], result.alias(out))


def emit_copies(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """The mix itself: each document as many times as it is taken, all columns as they are; an empty table gives an empty table."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{out}.copies").cast(T.IntegerType())))).drop("__copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP5_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (3.0::DOUBLE * source_size) / weight AS ceiling FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ceiling, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY ceiling, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c),
t AS (SELECT *, least(cap, max(CASE WHEN rest <= ceiling * weights THEN rest / weights END) OVER () * weight) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             row_number() OVER (PARTITION BY d.source ORDER BY CAST(floor(log2(d.size + 1) * 8) AS INT), d.doc_id NULLS FIRST) AS k,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
             CAST(('0x' || substr(md5(coalesce(d.source, chr(0)) || '|7'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(share * k + u) - floor(share * (k - 1) + u)) * size AS BIGINT) AS taken FROM r
"""
