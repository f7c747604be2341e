from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from dialogmill.operators import segment

SCHEMA = "source string, student_id string, entrance string, question string, answer string, ask_time timestamp_ntz, row_no long"
T0 = dt.datetime(2025, 3, 1, 8)


def log(spark, *items, student="s"):
    """items: (seconds after the start, entrance)."""
    return spark.createDataFrame([("f", student, e, "q", "a", T0 + dt.timedelta(seconds=s), k) for k, (s, e) in enumerate(items)], SCHEMA)


def numbers(df, column="dialog_no"):
    return [r[column] for r in df.orderBy("row_no").collect()]


def test_gap_of_exactly_the_limit_stays(spark):
    assert numbers(segment.segment_dialogs(log(spark, (0, "A"), (900, "A"), (1801, "A")))) == [1, 1, 2]


def test_entrance_there_and_back(spark):
    assert numbers(segment.segment_dialogs(log(spark, (0, "A"), (1, "B"), (2, "A")))) == [1, 2, 3]


def test_null_entrances_are_equal(spark):
    assert numbers(segment.split_by_entrance(log(spark, (0, None), (1, None), (2, "A"))), "chunk_no") == [1, 1, 2]


def test_equal_times_go_by_row(spark):
    assert numbers(segment.segment_dialogs(log(spark, (5, "A"), (5, "B"), (5, "B")))) == [1, 2, 2]


def mapped(spark, rows, pairs):
    chunks = segment.split_by_gap(rows)
    mapping = spark.createDataFrame([("f", "s", 1, k, v) for k, v in pairs], "source string, student_id string, chunk_no int, row_number int, session_id int")
    return numbers(segment.apply_session_mapping(chunks, mapping))


def test_mapping_back_and_forth_opens_three(spark):
    assert mapped(spark, log(spark, (0, "A"), (1, "A"), (2, "A")), [(1, 1), (2, 2), (3, 1)]) == [1, 2, 3]


def test_missing_rows_take_the_one_before(spark):
    assert mapped(spark, log(spark, (0, "A"), (1, "A"), (2, "A"), (3, "A")), [(2, 4), (4, 5)]) == [1, 2, 2, 3]


def test_no_mapping_leaves_the_chunk_whole(spark):
    assert mapped(spark, log(spark, (0, "A"), (1, "A")), []) == [1, 1]


def test_mapping_texts(spark):
    texts = ['{"1": 1, "2": 2}', "[1, 1, 2]", "```json\n{'1': 3,}\n```", "{1: 2}", '{"1": "x", "2": 5}', "", "nonsense", None]
    answers = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    got = sorted((r.id, r.row_number, r.session_id) for r in segment.parse_session_mapping(answers).collect())
    assert got[:6] == [(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 3)]
    assert (4, 2, 5) in got and not any(r[0] in (5, 6, 7) for r in got)


def test_no_row_lost_and_independent_of_partitions(spark, sf_dir):
    from dialogmill.jobs.fixtures import interactions

    rows = interactions(spark, sf_dir)
    once = {(r.row_no, r.dialog_no) for r in segment.segment_dialogs(rows, 600).collect()}
    again = {(r.row_no, r.dialog_no) for r in segment.segment_dialogs(rows.repartition(7), 600).collect()}
    assert once == again and len(once) == rows.count()


def test_payload_is_json_in_order(spark):
    payload = segment.chunk_payload(segment.split_by_gap(log(spark, (0, "A"), (1, "A"), (2, "A"))))
    text = segment.payload_json(payload).first().payload
    assert [x["row_number"] for x in __import__("json").loads(text)] == [1, 2, 3]


def test_live_sessions_keep_the_limit_together(spark):
    from dialogmill.streaming.sessions import live_sessions

    assert sorted(r.turns for r in live_sessions(log(spark, (0, "A"), (900, "A"), (1801, "A"))).collect()) == [1, 2]


def random_log(spark, seed):
    """Students of very unequal numbers of rows, equal and missing times, null students and entrances."""
    draw = random.Random(seed)
    students = ["busy"] * 60 + [None] * 20 + ["a", "b", "c"] * 5
    rows = []
    for k in range(1500):
        when = None if draw.random() < 0.02 else T0 + dt.timedelta(minutes=draw.choice([draw.randrange(60), draw.randrange(20_000)]))
        rows.append((draw.choice(["f", None]), draw.choice(students), draw.choice(["A", "A", "A", "B", None]), "q", "a", when, k))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("busy_rows", [0, 7, 60, 400])
def test_pieces_of_busy_students_change_nothing(spark, monkeypatch, busy_rows):
    rows = random_log(spark, busy_rows).repartition(5)
    monkeypatch.setattr(segment, "PIECES", 100)
    for split in (segment.split_by_entrance, segment.split_by_gap, segment.segment_dialogs):
        assert sorted(split(rows, out="n", busy_rows=busy_rows).collect(), key=str) == sorted(split(rows, out="n").collect(), key=str)


def test_pieces_carry_the_mapping_too(spark, monkeypatch):
    monkeypatch.setattr(segment, "PIECES", 10)
    chunks = segment.split_by_entrance(random_log(spark, 5).where("student_id = 'busy' AND source = 'f'"))
    mapping = chunks.where("row_no % 7 = 0").selectExpr("source", "student_id", "chunk_no", "1 + row_no % 2 AS row_number", "row_no % 3 AS session_id").dropDuplicates(["source", "student_id", "chunk_no", "row_number"])
    mapping = spark.createDataFrame(mapping.collect(), mapping.schema)
    whole = segment.apply_session_mapping(chunks, mapping).collect()
    assert sorted(whole) == sorted(segment.apply_session_mapping(chunks, mapping, busy_rows=10).collect())


def test_no_window_of_rows_above_a_piece(spark, monkeypatch):
    monkeypatch.setattr(segment, "PIECES", 100)
    rows = random_log(spark, 1)
    plan = segment.segment_dialogs(rows, busy_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__piece" in line for line in windows)
    cuts = segment.busy_cuts(rows, 10)
    pieces = rows.join(cuts, rows["student_id"].eqNullSafe(cuts["student_id"]) & rows["source"].eqNullSafe(cuts["source"]))
    pieces = pieces.select(cuts["source"], cuts["student_id"], segment._piece(F.unix_micros(F.col("ask_time").cast("timestamp")), F.col("__cuts")).alias("piece"))
    sizes = pieces.where("student_id = 'busy' AND piece >= 0").groupBy("source", "piece").count().collect()
    assert len(sizes) > 60 and max(r["count"] for r in sizes) < 30  # of some 500 rows each


def test_empty_log(spark):
    assert segment.segment_dialogs(spark.createDataFrame([], SCHEMA), busy_rows=0).collect() == []
