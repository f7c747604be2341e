"""Enrichment with school terms, semesters and disciplines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.functions.time import parse_mixed_date, parse_semester
from dialogmill.tables import numbered

# The term of classes whose school gives none, and the reasons told.
DEFAULT_START, DEFAULT_END = "2025-03-01 00:00:00", "2025-07-07 23:59:59"
SCHOOL_TIME, SCHOOL_MISSING, NOT_LISTED, UNKNOWN_WEEKS = "使用学校统一时间", "学校时间缺失 -> 使用默认区间", "平台未出现在学校信息表 -> 使用默认区间", "未知"
# Subjects and their disciplines.
DISCIPLINES = {
    "材料工程": "工学", "电气与电子工程": "工学", "核工程": "工学", "环境工程": "工学", "机械与能源工程": "工学", "土木建筑工程": "工学", "计算机科学与技术": "工学",
    "化学": "理学", "物理学": "理学", "数学与统计": "理学", "公共卫生": "医学", "护理学": "医学", "基础医学": "医学", "临床医学": "医学", "经济与金融": "经济学",
    "人力资源管理": "管理学", "教育学": "教育学", "心理学": "教育学", "人文与文化": "文学", "英语与外语": "文学", "通识与职业发展": "交叉学科",
}


def clean_platform(platform: Column) -> Column:
    return F.regexp_replace(F.trim(platform), "[﻿​]", "")


def clean_schools(schools: DataFrame) -> DataFrame:
    """Platform ids cleaned, term dates of either form parsed."""
    return schools.select(clean_platform(F.col("platform_id")).alias("platform_id"), *[parse_mixed_date(F.col(c).cast("string")).alias(c) for c in ("term_start", "term_end")], "weeks")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows as they are, or an error as soon as a key stands twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    return df.withColumn("__twice", twice).where(F.when(F.col("__twice"), F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))).isNull()).otherwise(True)).drop("__twice")


def assign_terms(classes: DataFrame, schools: DataFrame) -> DataFrame:
    """Adds term_start, term_end (as text), weeks and reason: the school's term, or the default where it is unknown or incomplete."""
    own = require_unique(schools, "platform_id").select(F.col("platform_id").alias("__platform"), "term_start", "term_end", F.col("weeks").alias("__weeks"))
    joined = classes.withColumn("platform_id", clean_platform(F.col("platform_id"))).join(own, F.col("platform_id") == F.col("__platform"), "left")
    full = F.col("term_start").isNotNull() & F.col("term_end").isNotNull()
    as_text = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    reason = F.when(F.col("__platform").isNull(), NOT_LISTED).when(~full, SCHOOL_MISSING).otherwise(SCHOOL_TIME)
    return joined.select(
        *classes.columns, F.when(full, as_text("term_start")).otherwise(DEFAULT_START).alias("term_start"), F.when(full, as_text("term_end")).otherwise(DEFAULT_END).alias("term_end"),
        F.coalesce(F.col("__weeks").cast("string"), F.lit(UNKNOWN_WEEKS)).alias("weeks"), reason.alias("reason"),
    )


def unmatched_platforms(classes: DataFrame, schools: DataFrame) -> DataFrame:
    return classes.select(clean_platform(F.col("platform_id")).alias("platform_id")).join(schools.select("platform_id"), "platform_id", "left_anti").distinct()


def append_semesters(rows: DataFrame, semesters: DataFrame, order: str) -> DataFrame:
    """The i-th row by ``order`` gets the i-th semester (column idx); what can't be read leaves nulls in its place."""
    places = numbered(rows, [order], "__idx")
    read = semesters.withColumn("__s", parse_semester(F.col("info"))).select(F.col("idx").alias("__idx"), *[F.date_format(f"__s.{c}", "yyyy年MM月dd日").alias(c) for c in ("term_start", "term_end")], "__s.weeks")
    return places.join(read, "__idx", "left").drop("__idx")


def discipline_frame(spark, mapping: dict[str, str] = DISCIPLINES) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "subject string, discipline string")


def by_discipline(rows: DataFrame, mapping: DataFrame, subject: str = "subject") -> tuple[DataFrame, DataFrame]:
    """(rows with a discipline, rows whose subject is unknown)."""
    key = mapping.select(F.col("subject").alias("__subject"), "discipline")  # Spark broadcasts it where it is small
    match = F.col(subject) == F.col("__subject")
    return rows.join(key, match).drop("__subject"), rows.join(key, match, "left_anti")


def concat_columns(left: DataFrame, right: DataFrame, index: str, numeric: Sequence[str], prefix: str = "transform_") -> DataFrame:
    """Rows side by side on an explicit index; the numeric columns of the right one are prefixed."""
    renamed = right.select(index, *[F.col(c).alias(prefix + c if c in numeric else c) for c in right.columns if c != index])
    return left.join(renamed, index, "left")


def choose_dimension_columns(df: DataFrame, platform_pattern: str = "平台|platform", date_pattern: str = r"\d{4}年|\d{4}-\d{2}") -> tuple[str | None, list[str], DataFrame]:
    """(platform column, columns with dates among the first 5 rows, the frame without all-blank columns) of a small raw dimension."""
    import re

    filled = df.agg(*[F.count(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1)).alias(c) for c in df.columns]).first()
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]])
    head = kept.limit(5).collect()
    dates = [c for c in kept.columns if re.search(date_pattern, " ".join(str(r[c]) for r in head))]
    return next((c for c in kept.columns if re.search(platform_pattern, c)), None), dates, kept
