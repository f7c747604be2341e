"""Live sessions by pause alone; the entrance rule needs the batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(rows: DataFrame, minutes: int = 15, late_minutes: int = 60) -> DataFrame:
    """(source, student_id, session_start, session_end, turns, total_time_minutes) of a stream or a table.

    A pause of exactly ``minutes`` keeps a session together, as in the batch job: the window is one microsecond longer.
    """
    marked = rows.withColumn("ask_time", F.col("ask_time").cast("timestamp")).withWatermark("ask_time", f"{late_minutes} minutes")
    window = F.session_window("ask_time", F.lit(f"{minutes} minutes 1 microsecond"))
    found = marked.groupBy("source", "student_id", window.alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.min("ask_time").alias("session_start"), F.max("ask_time").alias("session_end"))
    seconds = F.unix_micros("session_end") - F.unix_micros("session_start")
    return found.select("source", "student_id", "session_start", "session_end", "turns", (seconds / 60_000_000.0).alias("total_time_minutes"))
