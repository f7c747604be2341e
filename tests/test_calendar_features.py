from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dialogmill.functions.text import copy_keyword_count, normalize_text
from dialogmill.functions.time import calendar_week, parse_mixed_date, parse_semester
from dialogmill.operators import audit, features
from dialogmill.operators.calendar import calendar_search, calendar_lookups, with_distances

D = dt.datetime


def frames(spark, times):
    asked = spark.createDataFrame([("c", t, k) for k, t in enumerate(times)], "class_id string, ask_time timestamp_ntz, row_no long")
    schedule = spark.createDataFrame([("c", D(2025, 3, 1, 10), D(2025, 3, 1, 11)), ("c", D(2025, 3, 8, 10), D(2025, 3, 8, 11)), ("c", None, None)], "class_id string, session_start timestamp_ntz, session_end timestamp_ntz")
    homework = spark.createDataFrame([("c", D(2025, 3, 2), D(2025, 3, 4))], "class_id string, release_time timestamp_ntz, deadline_time timestamp_ntz")
    return asked, schedule, homework


@pytest.mark.parametrize("strategy", [calendar_lookups, calendar_search])
def test_boundaries(spark, strategy):
    times = [D(2025, 3, 1, 10), D(2025, 3, 1, 11), D(2025, 3, 2), D(2025, 3, 4), D(2025, 3, 1, 9), D(2025, 3, 9)]
    rows = with_distances(strategy(*frames(spark, times))).orderBy("row_no").collect()
    at_start, at_end, at_release, at_deadline, before, after = rows
    assert at_start.in_class_time == 1 and at_end.in_class_time == 1
    assert at_start.hours_to_next_class == 168.0  # the one that starts just now doesn't count: the next is a week off
    assert at_end.hours_from_last_class == 168.0  # nor does the one that ends just now
    assert at_release.hours_since_release == 0.0
    assert at_deadline.hours_to_assignment == 720.0
    assert before.hours_to_next_class == 1.0 and before.in_class_time == 0 and before.hours_since_release == 720.0
    assert after.hours_from_last_class == 13.0 and after.hours_to_next_class == 168.0


def test_strategies_agree(spark, sf_dir):
    from dialogmill.jobs import fixtures as fx

    parts = [f(spark, sf_dir) for f in (fx.dialogs, fx.schedule, fx.homework)]
    one, other = (sorted(map(tuple, with_distances(f(*parts)).select("row_no", "hours_to_next_class", "hours_from_last_class", "hours_to_assignment", "hours_since_release", "in_class_time").collect())) for f in (calendar_lookups, calendar_search))
    assert one == other


def test_searches_of_awkward_calendars(spark):
    """Classes without entries, null classes and times, equal times; and calendars that are too large to send."""
    asked = spark.createDataFrame([(c, t, k) for k, (c, t) in enumerate((c, t) for c in ("c", "none", None) for t in (D(2025, 3, 1, 10, 30), None))], "class_id string, ask_time timestamp_ntz, row_no long")
    sessions = [("c", D(2025, 3, 1, 10), D(2025, 3, 1, 11)), ("c", D(2025, 3, 1, 10), D(2025, 3, 1, 12)), (None, D(2025, 3, 1, 10), None)]
    schedule = spark.createDataFrame(sessions, "class_id string, session_start timestamp_ntz, session_end timestamp_ntz")
    homework = spark.createDataFrame([], "class_id string, release_time timestamp_ntz, deadline_time timestamp_ntz")
    found = [sorted(map(tuple, f.collect()), key=str) for f in (calendar_lookups(asked, schedule, homework), calendar_search(asked, schedule, homework), calendar_search(asked, schedule, homework, max_bytes=1))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    assert "Exchange" not in calendar_search(asked, schedule, homework)._jdf.queryExecution().executedPlan().toString()


def test_text(spark):
    df = spark.createDataFrame([("ＡＢ　ｃ\t这 道 题",), (None,)], "t string").select(normalize_text(F.col("t")).alias("n"), copy_keyword_count(normalize_text(F.col("t"))).alias("k"))
    a, b = df.collect()
    assert a.n == "ABc这道题" and a.k == 2  # the phrase and its last character
    assert b.n == "" and b.k == 0


def test_points_are_counted_per_match(spark):
    row = spark.createDataFrame([("5分10分A.",)], "t string").select(copy_keyword_count(normalize_text(F.col("t"))).alias("k")).first()
    assert row.k == 3


def test_dates(spark):
    df = spark.createDataFrame([("2025年2月17日至6月22日，18周",), ("2024年9月2日至2025年1月5日，17周",), ("2025年2月31日至6月22日，18周",), ("x",)], "t string").select(parse_semester(F.col("t")).alias("s")).select("s.*")
    assert [tuple(r) for r in df.collect()] == [(dt.date(2025, 2, 17), dt.date(2025, 6, 22), 18), (dt.date(2024, 9, 2), dt.date(2025, 1, 5), 17), (None, None, None), (None, None, None)]
    mixed = spark.createDataFrame([("2025年02月03日",), ("2025-02-03",), ("soon",), (None,)], "t string").select(parse_mixed_date(F.col("t")).alias("d"))
    assert [r.d for r in mixed.collect()] == [dt.date(2025, 2, 3)] * 2 + [None] * 2


def test_week_before_the_anchor_is_0(spark):
    df = spark.createDataFrame([(D(2025, 2, 16, 23),), (D(2025, 2, 17),)], "t timestamp_ntz").select(calendar_week(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [0, 1]


def test_picture_counts_unless_confused(spark):
    rows = spark.createDataFrame([(1, "![用户上传图片](x", "班级"), (2, "![用户上传图片](x", "课件不懂"), (2, "hm", "班级")], "d int, question string, entrance string")
    got = {r.d: (r.copy_keywords_count, r.is_copy_paste, r.is_confusion_entry) for r in features.with_text_marks(rows).groupBy("d").agg(*[c.alias(k) for k, c in {**features.copy_signs(), **features.entries()}.items()]).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1)}


def test_outcomes_in_order(spark):
    rows = [("f", str(k), 1, c, t, k) for k, (c, t) in enumerate([("a", D(2025, 3, 2)), ("a", None), ("b", D(2025, 3, 2)), ("z", D(2025, 3, 2)), ("n", D(2025, 3, 2)), ("a", D(2025, 4, 2)), ("a", D(2025, 3, 1))])]
    dialogs = spark.createDataFrame(rows, "source string, student_id string, dialog_no int, class_id string, ask_time timestamp_ntz, row_no long")
    windows = spark.createDataFrame([("a", D(2025, 3, 1), D(2025, 4, 1), 1), ("a", D(2020, 3, 1), D(2020, 4, 1), 2), ("n", None, None, 3), ("b", D(2025, 3, 1), D(2025, 4, 1), 4)], "class_id string, course_start timestamp_ntz, course_end timestamp_ntz, row_no int")
    allowed = spark.createDataFrame([("a",), ("z",), ("n",)], "class_id string")
    got = {r.student_id: r.outcome for r in audit.dialog_outcomes(dialogs, windows, allowed).collect()}
    assert got == {"0": "processed", "1": "invalid_times", "2": "filtered_by_class_info", "3": "no_class_info", "4": "invalid_window", "5": "out_of_range", "6": "processed"}
    assert {r.outcome for r in audit.dialog_outcomes(dialogs, windows, allowed.where("false")).collect()} >= {"processed"}


def test_audit_of_several_classes_takes_the_last(spark):
    rows = [("f", "s", 1, "a", D(2025, 3, 2), 1), ("f", "s", 1, "z", D(2025, 3, 2), 2)]
    dialogs = spark.createDataFrame(rows, "source string, student_id string, dialog_no int, class_id string, ask_time timestamp_ntz, row_no long")
    windows = spark.createDataFrame([("a", D(2025, 3, 1), D(2025, 4, 1), 1)], "class_id string, course_start timestamp_ntz, course_end timestamp_ntz, row_no int")
    row = audit.range_audit(dialogs, windows).first()
    assert (row.status, row.classes_unknown) == ("no_class_info", 1)
