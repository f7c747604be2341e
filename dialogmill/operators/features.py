"""One feature row per dialog, by one aggregation over enriched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.functions.text import WHY_KEYWORDS, contains_any, copy_keyword_count, has_image, normalize_text
from dialogmill.functions.time import calendar_week, day_period, is_weekend, micros, teaching_week, total_weeks
from dialogmill.operators.calendar import calendar_search, with_distances

# The entrances of a question.
CLASS_ENTRY, VIDEO, DISCUSSION, GRAPHIC, AI_TASK = "班级", "视频单元", "讨论单元", "图文单元", "课堂AI任务"
CONFUSION = ("课堂不懂", "课件不懂", "习题不懂")
# Entrances of the older feature set.
OLDER_ENTRIES = {"is_courseware_entry": "课件不懂", "is_discussion_entry": "讨论单元", "is_ai_task_entry": "课堂AI任务", "is_exercise_entry": "习题不懂"}

BINARY = (
    "is_multi_turn", "if_non_class", "is_copy_paste", "is_video_unit", "is_discussion_unit", "is_graphic_unit", "is_ai_task",
    "is_confusion_entry", "is_exam_week", "is_weekend", "is_in_class_time", "question_type_why",
)
CONTINUOUS = (
    "qa_turns", "total_time_minutes", "avg_qa_time_minutes", "total_question_chars", "avg_question_length", "avg_hours_to_assignment",
    "avg_hours_since_release", "course_progress_ratio", "calendar_week_since_2025_0217", "hours_to_next_class", "hours_from_last_class",
    "copy_keywords_count", "day_period",
)
#: Features that are taken as ln(1 + x) before the analysis.
LOGGED = (
    "avg_hours_since_release", "avg_hours_to_assignment", "avg_qa_time_minutes", "avg_question_length", "copy_keywords_count",
    "course_progress_ratio", "qa_turns", "total_question_chars", "total_time_minutes", "hours_from_last_class", "hours_to_next_class",
)


def _any(test: Column) -> Column:
    return F.max(F.coalesce(test, F.lit(False)).cast("int"))


def basic(time: str = "ask_time") -> dict[str, Column]:
    n = F.count(F.lit(1))
    minutes = (micros(F.max(time)) - micros(F.min(time))) / 60_000_000.0
    total = F.when(n > 1, minutes).otherwise(0.0)
    return {"qa_turns": n.cast("int"), "is_multi_turn": n > 1, "total_time_minutes": total, "avg_qa_time_minutes": F.when((n > 1) & (total > 0), total / (n - 1)).otherwise(0.0)}


def text(question: str = "question") -> dict[str, Column]:
    size = F.char_length(F.coalesce(F.col(question), F.lit("")))
    return {"total_question_chars": F.sum(size).cast("long"), "avg_question_length": F.avg(size)}


def entries(entrance: str = "entrance") -> dict[str, Column]:
    e = F.col(entrance)
    units = {"is_video_unit": VIDEO, "is_discussion_unit": DISCUSSION, "is_graphic_unit": GRAPHIC, "is_ai_task": AI_TASK}
    return {"if_non_class": _any(~e.eqNullSafe(F.lit(CLASS_ENTRY))), **{k: _any(e == v) for k, v in units.items()}, "is_confusion_entry": _any(e.isin(*CONFUSION))}


def older_entries(entrance: str = "entrance") -> dict[str, Column]:
    return {k: _any(F.col(entrance) == v) for k, v in OLDER_ENTRIES.items()}


def copy_signs(keywords_count: str = "__keywords", image: str = "__image", confusion: Column | None = None) -> dict[str, Column]:
    """Keyword hits of all rows; a picture counts unless the dialog came by an entrance for what wasn't understood."""
    confused = entries()["is_confusion_entry"] if confusion is None else confusion
    n = F.sum(F.col(keywords_count)) + F.when(confused == 0, F.sum(F.col(image).cast("int"))).otherwise(0)
    return {"copy_keywords_count": n.cast("long"), "is_copy_paste": (n > 0).cast("int")}


def why(question: str = "question") -> Column:
    return _any(contains_any(F.coalesce(F.col(question), F.lit("")), WHY_KEYWORDS))


def with_text_marks(rows: DataFrame, question: str = "question") -> DataFrame:
    return rows.withColumns({"__keywords": copy_keyword_count(normalize_text(F.col(question))), "__image": has_image(F.col(question))})


def distances() -> dict[str, Column]:
    return {
        "avg_hours_to_assignment": F.avg("hours_to_assignment"), "avg_hours_since_release": F.avg("hours_since_release"),
        "hours_to_next_class": F.avg("hours_to_next_class"), "hours_from_last_class": F.avg("hours_from_last_class"), "is_in_class_time": F.max("in_class_time"),
    }


def clock(first: Column) -> dict[str, Column]:
    return {"calendar_week_since_2025_0217": calendar_week(first), "day_period": day_period(first), "is_weekend": is_weekend(first)}


def first_windows(class_windows: DataFrame, order: str = "row_no") -> DataFrame:
    """One window per class, the first by ``order``."""
    first = Window.partitionBy("class_id").orderBy(order)
    return class_windows.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("class_id", "course_start", "course_end")


def with_dialog_class(dialogs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds what decides on a whole dialog: __class (that of its first row), __bad (a time is missing), __low and __high."""
    whole = Window.partitionBy(*key)
    in_order = whole.orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dialogs.withColumns({
        "__class": F.first("class_id").over(in_order),
        "__bad": F.max(F.col("ask_time").isNull()).over(whole),
        "__low": F.min("ask_time").over(whole),
        "__high": F.max("ask_time").over(whole),
    })


def extract_features(dialogs: DataFrame, class_windows: DataFrame, schedule: DataFrame, homework: DataFrame, key: tuple[str, ...] = ("source", "student_id", "dialog_no")) -> DataFrame:
    """All 25 features of every dialog that lies wholly in its class's window.

    dialogs: rows with ``key``, class_id, entrance, question, ask_time and row_no. The class of a dialog's first row is
    that of all its rows. Dialogs with a missing time, and those of a class without a whole window, are left out, as
    ``audit.dialog_outcomes`` tells. Answers are never needed, so they aren't read.

    Windows over a dialog need no shuffle behind ``segment_dialogs``, which has dealt rows out by student; dialogs that don't
    count go before any row travels. Calendars that fit are searched where the rows are, else a shuffle by class and time
    carries rows to them; the aggregation by dialog is behind either.
    """
    narrow = dialogs.select(*key, "class_id", "entrance", "question", "ask_time", "row_no")
    decided = with_dialog_class(narrow, key).where("NOT __bad").drop("__bad").withColumn("class_id", F.col("__class")).drop("__class")
    inside = decided.join(first_windows(class_windows), "class_id").where("__low >= course_start AND __high <= course_end").drop("__low", "__high")
    question = F.coalesce("question", F.lit(""))
    marked = with_text_marks(inside).withColumns({"__why": contains_any(question, WHY_KEYWORDS), "__size": F.char_length(question)}).drop("question")
    looked = with_distances(calendar_search(marked, schedule, homework))
    rows = looked.withColumn("__week", teaching_week(F.col("ask_time"), F.col("course_start"), F.col("course_end")))
    weeks = total_weeks(F.col("course_start"), F.col("course_end"))
    first = F.min("ask_time")
    values = {
        "class_id": F.min_by("class_id", "row_no"),
        **basic(),
        "total_question_chars": F.sum("__size").cast("long"),
        "avg_question_length": F.avg("__size"),
        **entries(),
        **copy_signs(),
        **distances(),
        "course_progress_ratio": F.avg(F.col("__week") / weeks),
        **clock(first),
        "is_exam_week": (F.min_by("__week", "ask_time") >= F.first(weeks) - 1).cast("int"),
        "question_type_why": _any(F.col("__why")),
    }
    return rows.groupBy(*key).agg(*[c.alias(k) for k, c in values.items()])
