"""Outcomes of dialogs, and audits of their times and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.operators.features import first_windows

OUTCOMES = ("invalid_times", "filtered_by_class_info", "no_class_info", "invalid_window", "out_of_range", "processed")


def dialog_spans(dialogs: DataFrame, key: tuple[str, ...] = ("source", "student_id", "dialog_no")) -> DataFrame:
    return dialogs.groupBy(*key).agg(
        F.min_by("class_id", "row_no").alias("class_id"), F.min("ask_time").alias("first_time"), F.max("ask_time").alias("last_time"), F.bool_or(F.col("ask_time").isNull()).alias("bad_time"),
    )


def dialogs_in_window(dialogs: DataFrame, class_windows: DataFrame) -> DataFrame:
    """Dialogs from the window's start to its end, both included."""
    spans = dialog_spans(dialogs).join(first_windows(class_windows), "class_id")
    return spans.where("first_time >= course_start AND last_time <= course_end").drop("course_start", "course_end", "bad_time")


def dialog_outcomes(dialogs: DataFrame, class_windows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Every dialog with the first rule that it fails, or processed. An empty list of allowed classes allows all."""
    spans = dialog_spans(dialogs).join(first_windows(class_windows).withColumn("__known", F.lit(True)), "class_id", "left")
    barred = F.lit(False)
    if allowed is not None:
        listed = allowed.select(F.col("class_id").cast("string").alias("__allowed")).distinct()
        some = listed.agg((F.count(F.lit(1)) > 0).alias("__some"))
        spans = spans.join(listed, F.col("class_id") == F.col("__allowed"), "left").join(F.broadcast(some))
        barred = F.col("__some") & F.col("__allowed").isNull()
    outcome = (
        F.when(F.col("bad_time"), "invalid_times").when(barred, "filtered_by_class_info").when(F.col("__known").isNull(), "no_class_info")
        .when(F.col("course_start").isNull() | F.col("course_end").isNull(), "invalid_window")
        .when((F.col("first_time") < F.col("course_start")) | (F.col("last_time") > F.col("course_end")), "out_of_range").otherwise("processed")
    )
    return spans.withColumn("outcome", outcome).drop("__known", "__allowed", "__some", "bad_time", "course_start", "course_end")


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    """One row: total, a count for each outcome, and the shares of those processed, out of range and failed."""
    total = F.count(F.lit(1))
    count = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in OUTCOMES}
    share = lambda n: F.round(n / F.greatest(total, F.lit(1)), 6)
    return outcomes.agg(
        total.alias("total"), *[c.alias(o) for o, c in count.items()], share(count["processed"]).alias("success_ratio"),
        share(count["out_of_range"]).alias("out_of_range_ratio"), share(total - count["processed"] - count["out_of_range"]).alias("fail_ratio"),
    )


def allow_classes(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of allowed classes, compared as strings."""
    return rows.join(allowed.select(F.col("class_id").cast("string").alias("__allowed")), F.col("class_id").cast("string") == F.col("__allowed"), "left_semi")


def class_presence(dialogs: DataFrame, class_windows: DataFrame, key: tuple[str, ...] = ("source", "student_id", "dialog_no")) -> DataFrame:
    """Each dialog's first class id that isn't blank, and whether a window is known for it."""
    clean = F.trim("class_id")
    first = dialogs.groupBy(*key).agg(F.min_by(clean, F.when(clean != "", F.col("row_no"))).alias("class_id"))
    known = class_windows.select(F.trim("class_id").alias("class_id")).distinct().withColumn("__known", F.lit(True))
    return first.join(known, "class_id", "left").withColumn("present", F.coalesce("__known", F.lit(False))).drop("__known")


def range_audit(dialogs: DataFrame, class_windows: DataFrame, key: tuple[str, ...] = ("source", "student_id", "dialog_no")) -> DataFrame:
    """Each dialog as before, after or in_range of its window (any overlap counts); of several classes the last to appear decides, without a window: no_class_info."""
    by_class = dialogs.groupBy(*key, "class_id").agg(F.min("ask_time").alias("low"), F.max("ask_time").alias("high"), F.min("row_no").alias("place"))
    status = F.when(F.col("course_start").isNull() | F.col("course_end").isNull(), "no_class_info").when(F.col("high") < F.col("course_start"), "before").when(F.col("low") > F.col("course_end"), "after").otherwise("in_range")
    judged = by_class.join(first_windows(class_windows), "class_id", "left").withColumn("status", status)
    return judged.groupBy(*key).agg(F.max_by("status", "place").alias("status"), F.count(F.when(F.col("status") == "no_class_info", 1)).alias("classes_unknown"))


def longest_students(dialogs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` students with most rows, first ones first: each is one window partition of the segmentation, so this is its longest task."""
    counts = dialogs.groupBy("source", "student_id").agg(F.count(F.lit(1)).alias("n_rows"))
    order = [F.desc("n_rows"), "source", "student_id"]
    return counts.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
