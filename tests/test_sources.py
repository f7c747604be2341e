from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from dialogmill.jobs import export
from dialogmill.sources import logs, records

HEAD = "学生ID,提问时间,提问内容,AI回复,教学班ID"


def test_log_with_quotes_and_bad_times(spark, tmp_path):
    (tmp_path / "math.csv").write_text("﻿" + HEAD + '\ns1,2025-03-01 10:00:00,"a ""b""\nc",ok,7\ns1,never,x,y,7\n', encoding="utf-8")
    rows = logs.read_interactions(spark, str(tmp_path)).collect()
    assert [(r.source, r.student_id, r.question, r.class_id) for r in rows] == [("math", "s1", 'a "b" c', "7")]


def test_log_without_students_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("提问时间,提问内容\n2025-03-01 10:00:00,q\n", encoding="utf-8")
    with pytest.raises(logs.MissingColumns):
        logs.read_interactions(spark, str(tmp_path))


def test_logs_with_other_columns_and_orders(spark, tmp_path):
    row = {"学生ID": "s1", "提问时间": "2025-03-01 10:00:00", "提问内容": "q", "AI回复": "a", "教学班ID": "7", "提问入口": "班级", " note ": "n"}
    layouts = {"a": ["学生ID", "提问时间", "提问内容", "AI回复", "教学班ID", "提问入口"], "b": ["提问入口", "AI回复", " note ", "提问时间", "学生ID", "教学班ID", "提问内容"], "c": ["教学班ID", "提问内容", "提问时间", "AI回复", "学生ID"]}
    for name, head in layouts.items():
        (tmp_path / f"{name}.csv").write_text(f"{','.join(head)}\n{','.join(row[c] for c in head)}\n", encoding="utf-8-sig")
    rows = {r.source: r for r in logs.read_interactions(spark, str(tmp_path)).collect()}
    assert {k: (r.student_id, str(r.ask_time), r.question, r.answer, r.class_id, r.entrance, r.note) for k, r in rows.items()} == {
        k: ("s1", "2025-03-01 10:00:00", "q", "a", "7", "班级" if k != "c" else None, "n" if k == "b" else None) for k in "abc"
    }
    (tmp_path / "d.csv").write_text("提问时间,提问内容\n2025-03-01 10:00:00,q\n", encoding="utf-8")
    with pytest.raises(logs.MissingColumns, match="d.csv lacks student_id"):
        logs.read_interactions(spark, str(tmp_path))
    assert logs.read_interactions(spark, str(tmp_path), skip_incomplete=True).count() == 3


def test_reference_tables(spark, tmp_path):
    files = {"w": "教学班ID,开始时间,结束时间\n1,2025-02-17,2025-06-22\n", "h": "教学班ID,发布时间,提交截止时间\n1,2025-03-01,2025-03-08\n", "s": "结课时间,教学班ID,开课时间\n2025-03-01 11:00:00,1,2025-03-01 10:00:00\n", "k": "教学班ID\n1\n", "p": "平台ID,开始时间\n9,2025年2月17日\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8-sig")
    paths = {k: str(tmp_path / f"{k}.csv") for k in files}
    found = logs.load_reference(spark, paths["w"], paths["h"], paths["s"], paths["p"], paths["k"])
    assert str(found["schedule"].first().session_start) == "2025-03-01 10:00:00" and found["allowed"].first().class_id == "1" and found["schools"].first().course_start == "2025年2月17日"
    assert logs.load_reference(spark, paths["w"], paths["h"], paths["s"])["allowed"] is None
    with pytest.raises(logs.MissingColumns):
        logs.load_reference(spark, paths["h"], paths["h"], paths["s"])


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s_1.csv").write_text(HEAD + "\n", encoding="utf-8")
    (tmp_path / "pca_result.csv").write_text(HEAD + "\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_text("提问时间,other\n", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: (r.accepted, r.reason) for r in logs.discover_logs(spark, str(tmp_path)).collect()}
    assert got["s_1.csv"] == (True, None) and got["pca_result.csv"] == (False, "excluded name") and got["bad.csv"][1].startswith("lacks")


def test_calendars_take_both_names(spark, tmp_path):
    for k, name in enumerate(("开始时间", "起始时间")):
        path = tmp_path / f"{k}.csv"
        path.write_text(f"教学班ID,{name},结束时间\n1,2025-02-17 09:38:59,bad\n", encoding="utf-8")
        row = logs.read_calendar(spark, str(path), ["course_start", "course_end"]).first()
        assert str(row.course_start) == "2025-02-17 09:38:59" and row.course_end is None


def test_encodings(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("教学班ID\n课\n".encode("gb18030"))
    (tmp_path / "u.csv").write_bytes("教学班ID\n课\n".encode("utf-8-sig"))
    assert [r.cells for r in logs.read_any_encoding(spark, str(tmp_path)).collect()] == [{"教学班ID": "课"}] * 2


def test_partitioned_export(spark, tmp_path):
    df = spark.range(100).withColumn("cluster", F.col("id") % 3)
    export.write_by(df, str(tmp_path / "out"), "cluster")
    assert spark.read.parquet(str(tmp_path / "out")).where("cluster = 1").count() == 33
    export.write_csv(df, str(tmp_path / "csv"))
    export.write_stats(df.agg(F.count("*").alias("n")), str(tmp_path / "stats"), job="x")
    assert spark.read.json(str(tmp_path / "stats")).first().n == 100


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def cell(draw):
    return draw.choice(["", "plain", "课件", 'said "no"', "a, b", "two\nlines", '\n\n"\n', "long " * draw.randrange(1, 80), 'x"y', " sp ", "'"])


def test_records_of_many_splits_equal_a_whole_read(spark, tmp_path, small_splits):
    """Cells with line breaks lie over the cuts of the file, which is read in hundreds of splits."""
    draw = random.Random(2)
    rows = [[f"s{k}", "2025-03-01 10:00:00", cell(draw), cell(draw)] for k in range(800)]
    with open(tmp_path / "one.csv", "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["学生ID", "提问时间", "提问内容", "AI回复"])
        out.writerows(rows)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
    found = logs.read_csv(spark, str(tmp_path), logs.INTERACTION_COLUMNS, ["student_id"], "log").orderBy("row_no").collect()
    assert [(r.student_id, r.question, r.answer) for r in found] == [(a, q or None, z or None) for a, _, q, z in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path)).collect()
    assert [tuple(r) for r in whole] == [(r.student_id, r.ask_time, r.question, r.answer) for r in found]
    assert len({r.row_no for r in found}) == 800


@pytest.mark.parametrize("seed", range(30))
def test_open_cells_are_those_of_a_parser(seed):
    """What stands behind a line follows from the cells of Python's own parser."""
    draw = random.Random(seed)
    text = ",".join(draw.choice(['"a""b"', '"x\ny"', "p", "", '"q""\n""r"', '"tail"t', 'mid"dle', '"\n,\n"']) for _ in range(20))
    lines, inside = text.split("\n"), False
    for k, line in enumerate(lines):
        inside = records.after_line(line.encode(), inside)
        rest = list(csv.reader(io.StringIO("\n".join(lines[: k + 1]) + "\n", newline="")))
        more = list(csv.reader(io.StringIO("\n".join(lines[: k + 1]) + "\n!", newline="")))
        assert inside == (len(more) == len(rest))


def test_windows_line_ends_and_blank_lines(spark, tmp_path, small_splits):
    lines = [HEAD, 's1,2025-03-01 10:00:00,"a', 'b",ok,7', "", "s2,2025-03-01 10:00:01,q,a,7"]
    (tmp_path / "w.csv").write_bytes("\r\n".join(lines).encode("utf-8-sig"))
    rows = logs.read_csv(spark, str(tmp_path), logs.INTERACTION_COLUMNS, ["student_id"], "log").orderBy("row_no").collect()
    assert [(r.student_id, r.question, r.class_id) for r in rows] == [("s1", "a\nb", "7"), ("s2", "q", "7")]


def test_files_of_one_name_are_different_sources(spark, tmp_path):
    for k, folder in enumerate(("p", "q", "q/deep +1%", "课")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"{HEAD}\ns1,2025-03-01 10:00:0{k},q,a,7\n", encoding="utf-8")
    rows = logs.read_interactions(spark, str(tmp_path), recursive=True).collect()
    assert sorted(r.source for r in rows) == ["p/x", "q/deep +1%/x", "q/x", "课/x"]
    assert {r.source for r in logs.read_interactions(spark, [str(tmp_path / "p"), str(tmp_path / "q")]).collect()} == {"p/x", "q/x"}
    assert {r.source for r in logs.read_interactions(spark, str(tmp_path / "p/x.csv")).collect()} == {"x"}
    from dialogmill.operators import segment

    dialogs = segment.split_by_gap(logs.read_interactions(spark, str(tmp_path), recursive=True), out="dialog_no", busy_rows=0)
    assert segment.dialogs_per_student(dialogs).count() == 4


def test_names_with_signs_of_patterns(spark, tmp_path):
    (tmp_path / "a[1]{2}.csv").write_text(f"{HEAD}\ns1,2025-03-01 10:00:00,q,a,7\n", encoding="utf-8")
    assert [r.source for r in logs.read_interactions(spark, str(tmp_path)).collect()] == ["a[1]{2}"]


def test_encodings_are_settled_file_by_file(spark, tmp_path, small_splits):
    """The first lines fit every encoding; a later one decides."""
    text = "k,v\n" + "1,plain\n" * 100 + '2,"课程\n，“引号”"\n' + "3,end\n" * 50
    for name, encoding in (("g", "gb18030"), ("u", "utf-8"), ("b", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    found = logs.read_any_encoding(spark, str(tmp_path)).collect()
    for name in "gub":
        own = {r.row: r.cells for r in found if r.path.endswith(f"/{name}.csv")}
        assert sorted(own) == list(range(1, 152)) and own[101] == {"k": "2", "v": "课程\n，“引号”"} and own[151] == {"k": "3", "v": "end"}
    (tmp_path / "z.csv").write_bytes(b"k\n\xff\xff\n")
    with pytest.raises(ValueError, match="z.csv fits none"):
        logs.read_any_encoding(spark, str(tmp_path))


def test_discovery_stops_at_the_header(spark, tmp_path):
    """Of a large file each task reads some lines at most."""
    with open(tmp_path / "big.csv", "w", encoding="utf-8-sig") as f:
        f.write(HEAD + "\n" + "s1,2025-03-01 10:00:00,q,a,7\n" * 400_000)
    got = {r.path.rsplit("/", 1)[1]: (r.accepted, r.reason) for r in logs.discover_logs(spark, str(tmp_path)).collect()}
    assert got["big.csv"] == (True, None)
    heads = {r["path"].rsplit("/", 1)[1]: r["head"] for r in records.first_records(spark, str(tmp_path)).collect()}
    assert heads["big.csv"].decode() == HEAD
