"""The given tables in the shape of the domain's, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.operators.segment import dialog_id, segment_dialogs

ENTRANCES = {"view": "视频单元", "click": "班级", "signup": "讨论单元", "purchase": "课堂AI任务", "error": "课件不懂"}
#: The pause that ends a dialog in the queries on features: events are sparse.
GAP_MINUTES = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entrance = F.create_map(*[F.lit(x) for pair in ENTRANCES.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"), F.col("user_id").cast("string").alias("student_id"), (F.col("user_id") % 10).cast("string").alias("class_id"), entrance.alias("entrance"),
        F.col("props").alias("question"), F.col("event_type").alias("answer"), F.col("ts").alias("ask_time"), F.col("event_id").alias("row_no"),
    )


def dialogs(spark: SparkSession, sf_dir: str, minutes: float = GAP_MINUTES) -> DataFrame:
    return segment_dialogs(interactions(spark, sf_dir), minutes)


def with_dialog_id(df: DataFrame) -> DataFrame:
    return df.withColumn("dialog_id", dialog_id())


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.select((F.col("user_id") % 10).cast("string").alias("class_id"), F.col("ts").alias("session_start"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("session_end"))


def homework(spark: SparkSession, sf_dir: str) -> DataFrame:
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return signups.select((F.col("user_id") % 10).cast("string").alias("class_id"), F.col("ts").alias("release_time"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("deadline_time"))


def class_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of classes 0 to 8; class 9 has none, and that of class 8 has no end."""
    events = table(spark, sf_dir, "events").where("user_id % 10 < 9").groupBy((F.col("user_id") % 10).cast("string").alias("class_id"))
    day = F.expr("INTERVAL 1 DAY")
    windows = events.agg((F.min("ts") + day).alias("course_start"), (F.max("ts") - day).alias("course_end"))
    return windows.withColumn("course_end", F.when(F.col("class_id") != "8", F.col("course_end"))).withColumn("row_no", F.col("class_id").cast("int"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    entrance = F.when(F.col("conv_id") % 3 == 0, "课件不懂").otherwise("班级")
    return said.select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("row_no"), F.col("text").alias("question"), entrance.alias("entrance"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature row per dialog with a cluster that follows from the student's number."""
    from dialogmill.functions.time import day_period, is_weekend
    from dialogmill.operators.features import basic, text

    first = F.min("ask_time")
    rows = dialogs(spark, sf_dir).groupBy("source", "student_id", "dialog_no")
    out = rows.agg(*[c.alias(k) for k, c in {**basic(), **text()}.items()], day_period(first).alias("day_period"), is_weekend(first).alias("is_weekend"))
    cluster = (F.col("student_id").cast("int") % 4).cast("int")
    return out.select(F.concat_ws("_", "source", "student_id", "dialog_no").alias("dialog_id"), cluster.alias("cluster"), F.col("is_multi_turn").cast("int").alias("is_multi_turn"), *[c for c in out.columns if c not in ("source", "student_id", "dialog_no", "is_multi_turn")])


#: Numeric columns of ``clustered``.
FEATURES = ("qa_turns", "is_multi_turn", "total_time_minutes", "avg_qa_time_minutes", "total_question_chars", "avg_question_length", "day_period", "is_weekend")

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTRANCES.items())
I_SQL = f"""i AS (SELECT 'events' AS source, CAST(user_id AS VARCHAR) AS student_id, CAST(user_id % 10 AS VARCHAR) AS class_id,
  CASE event_type {_CASE} END AS entrance, props AS question, event_type AS answer, ts AS ask_time, event_id AS row_no FROM events)"""


def segments_sql(minutes: int, by_entrance: bool = True, by_gap: bool = True, name: str = "d", number: str = "dialog_no") -> str:
    rules = ["lag(row_no) OVER w IS NULL"]
    rules += ["entrance IS DISTINCT FROM lag(entrance) OVER w"] if by_entrance else []
    rules += [f"epoch_us(ask_time) - epoch_us(lag(ask_time) OVER w) > {minutes * 60_000_000}"] if by_gap else []
    return f"""{name}_b AS (SELECT *, CASE WHEN {' OR '.join(rules)} THEN 1 ELSE 0 END AS b FROM i WINDOW w AS (PARTITION BY student_id ORDER BY ask_time, row_no)),
{name} AS (SELECT * EXCLUDE (b), CAST(sum(b) OVER (PARTITION BY student_id ORDER BY ask_time, row_no ROWS UNBOUNDED PRECEDING) AS INT) AS {number} FROM {name}_b)"""


D_SQL = f"WITH {I_SQL}, {segments_sql(GAP_MINUTES)}"
SCHEDULE_SQL = "sc AS (SELECT CAST(user_id % 10 AS VARCHAR) AS class_id, ts AS session_start, ts + INTERVAL 90 MINUTE AS session_end FROM events WHERE event_type = 'view')"
HOMEWORK_SQL = "hw AS (SELECT CAST(user_id % 10 AS VARCHAR) AS class_id, ts AS release_time, ts + INTERVAL 7 DAY AS deadline_time FROM events WHERE event_type = 'signup')"
WINDOWS_SQL = """cw AS (SELECT CAST(user_id % 10 AS VARCHAR) AS class_id, min(ts) + INTERVAL 1 DAY AS course_start,
  CASE WHEN user_id % 10 <> 8 THEN max(ts) - INTERVAL 1 DAY END AS course_end FROM events WHERE user_id % 10 < 9 GROUP BY user_id % 10)"""
TEXT_SQL = "tr AS (SELECT conv_id AS dialog_id, turn AS row_no, text AS question, CASE WHEN conv_id % 3 = 0 THEN '课件不懂' ELSE '班级' END AS entrance FROM conversations WHERE role = 'user')"
C_SQL = f"""{D_SQL}, c0 AS (SELECT student_id, dialog_no, count(*) AS n, (epoch_us(max(ask_time)) - epoch_us(min(ask_time))) / 60000000.0 AS span,
    sum(length(question)) AS chars, avg(length(question)) AS len, min(ask_time) AS t FROM d GROUP BY student_id, dialog_no),
c AS (SELECT 'events_' || student_id || '_' || dialog_no AS dialog_id, CAST(CAST(student_id AS INT) % 4 AS INT) AS cluster, CAST(n > 1 AS INT) AS is_multi_turn, CAST(n AS INT) AS qa_turns,
  CASE WHEN n > 1 THEN span ELSE 0.0 END AS total_time_minutes, CASE WHEN n > 1 AND span > 0 THEN span / (n - 1) ELSE 0.0 END AS avg_qa_time_minutes,
  CAST(chars AS BIGINT) AS total_question_chars, len AS avg_question_length, hour(t) + minute(t) / 60.0 AS day_period, CAST(isodow(t) >= 6 AS INT) AS is_weekend FROM c0)"""


def long_sql(columns=FEATURES, keys: str = "", source: str = "c") -> str:
    """SQL of the long form (keys, feature, value)."""
    return " UNION ALL ".join(f"SELECT {keys}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}" for f in columns)
