"""Line dedup: lines that many documents hold are dropped everywhere, the rest is put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import ASCII_SPACE, ascii_lower, settled, table

_ID, _ROW, _POS, _H1, _H2 = "__id", "__row", "__pos", "__h1", "__h2"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, out: str = "line_dedup") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` freed of frequent lines.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at
    least ``min_chars`` code points that occur in at least ``min_docs`` distinct ids lose all
    their lines; the others stay in place, joined by a line feed. ``out`` is a struct
    (n_lines, n_dropped) and replaces a column of that name.

    A null text counts as one empty line and becomes "". Null ids count as one document. Repeated rows are
    kept, each cleaned alone, and count once. An empty table gives an empty table.

    Keys travel as 128 hash bits. The count is pre-aggregated by (key, id), so a line of every document
    costs no task more than others. The frequent keys are a written table: where Spark finds it small enough it
    is broadcast, else both sides are shuffled anew for the join, whose hot keys adaptive execution splits. Texts are shuffled once at most, by row.
    """
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = (
        docs.select(F.col(id_col).alias(_ID), row.alias(_ROW), F.posexplode(_lines(F.col(text_col))).alias(_POS, "__line"))
        .withColumn("__key", line_key(F.col("__line")))
        .where(F.char_length("__key") >= min_chars)
        .select(_ID, _ROW, _POS, F.xxhash64("__key").alias(_H1), F.xxhash64(F.lit(1), F.col("__key")).alias(_H2))
    )
    frequent = settled(lines.select(_H1, _H2, _ID).distinct().groupBy(_H1, _H2).count().where(F.col("count") >= min_docs).select(_H1, _H2), "frequent-lines")
    dropped = (
        lines.join(frequent, [_H1, _H2], "left_semi")
        .groupBy(_ID, _ROW)
        .agg(F.collect_set(_POS).alias("__dropped"))
        .select(F.col(_ID).alias("__id2"), F.col(_ROW).alias("__row2"), "__dropped")
    )
    found = docs.withColumn(_ROW, row).join(dropped, F.col(id_col).eqNullSafe(F.col("__id2")) & (F.col(_ROW) == F.col("__row2")), "left")
    found = found.withColumn("__lines", _lines(F.col(text_col)))  # split once a text, not once a line
    all_lines = F.col("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__dropped")), lambda i: F.get(all_lines, i))
    text = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(F.size(all_lines).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    names = [c for c in docs.columns if c != out]
    return found.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], counts.alias(out))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
