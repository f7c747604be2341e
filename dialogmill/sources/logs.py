"""Interaction logs and calendars from CSV, each file by the names in its own header line."""

from __future__ import annotations

import csv
import os
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.operators.clean import clean_interactions
from dialogmill.sources import records

# Columns of the logs and calendars, and their names here.
INTERACTION_COLUMNS = {
    "平台ID": "platform_id", "课程名称": "course_name", "教学班ID": "class_id", "学生ID": "student_id", "提问入口": "entrance", "提问内容": "question", "AI回复": "answer",
    "提问轮次(一个会话一天内)": "turn_no", "提问时间": "ask_time",
}
CALENDAR_COLUMNS = {
    "平台ID": "platform_id", "课程名称": "course_name", "教学班ID": "class_id", "开始时间": "course_start", "起始时间": "course_start", "结束时间": "course_end",
    "发布时间": "release_time", "提交截止时间": "deadline_time", "开课时间": "session_start", "结课时间": "session_end", "持续多少周": "weeks",
}
# Names that mark results instead of logs.
EXCLUDED_NAMES = ("feature", "cluster", "result", "statistic", "analysis", "pca")
#: Bits of ``row_no`` that count a file's records; those above are the file's number.
FILE_BITS = 40
_TIMES = ("course_start", "course_end", "release_time", "deadline_time", "session_start", "session_end")


class MissingColumns(ValueError):
    """A source lacks columns that the job needs."""


def names_of(head: bytes | None, encoding: str = "utf-8") -> tuple[str, ...]:
    """Names of a header record, stripped of blanks and byte order marks."""
    cells = next(csv.reader([head.decode(encoding, "replace")]), []) if head else []
    return tuple(c.strip().strip("\ufeff").strip() for c in cells)


def _folder(path: str | list[str], files: Sequence[str]) -> str:
    """The folder that sources are named from: the one that is read, or that which all files share."""
    if isinstance(path, str):
        root = path.rstrip("/") + "/"
        at = {f.index(root) + len(root) for f in files if root in f}
        if len(at) == 1 and all(root in f for f in files):
            return files[0][: at.pop()]
    return os.path.commonpath([os.path.dirname(f) for f in files]) + "/" if files else ""


def read_csv(
    spark: SparkSession, path: str | list[str], names: dict[str, str], required: Sequence[str], what: str, recursive: bool = False, skip_incomplete: bool = False,
    encodings: Sequence[str] = ("utf-8",),
) -> DataFrame:
    """Rows of all CSV files as texts, columns renamed by ``names`` (unknown ones keep theirs), with ``source`` and ``row_no``.

    ``source`` is the path from the folder that is read, without ending, so files of one name in several folders are different sources.
    ``row_no`` rises along each file, and from file to file by path. Files are read in splits (see ``records``), those with one header and one
    encoding (the first of ``encodings`` that fits, else the first) together; those of different headers are put together by name, so neither the order of
    columns nor an absent one matters; what a file lacks is null. Files that lack a required column fail the
    job, or are left out with ``skip_incomplete``; if none is left, the job fails.
    """
    blocks = records.survey(spark, path, encodings, recursive)
    found = sorted((unquote(r["path"]), r["path"], r["encoding"] or encodings[0], r["head"]) for r in records.files_of(blocks, encodings).collect())
    groups: dict[tuple[tuple[str, ...], str], list[tuple[str, int]]] = defaultdict(list)
    for number, (_, file, encoding, head) in enumerate(found):
        groups[tuple(names.get(c, c) for c in names_of(head, encoding)), encoding].append((file, number))
    lacking = {group: [n for n in required if n not in group[0]] for group in groups}
    usable = {group: files for group, files in groups.items() if not lacking[group]}
    if not usable or (len(usable) < len(groups) and not skip_incomplete):
        bad = next((group for group in groups if lacking[group]), None)
        raise MissingColumns(f"{what} {unquote(groups[bad][0][0])} lacks {', '.join(lacking[bad])}" if bad is not None else f"no {what} under {path}")
    folder = _folder(path, [f for f, *_ in found])

    def rows(head: tuple[str, ...], encoding: str, files: list[tuple[str, int]]) -> DataFrame:
        wanted = list(dict.fromkeys(c for c in head if c))
        cells = records.parsed(records.read_records(spark, files, blocks, encoding), len(head))
        plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
        source = F.regexp_replace(F.substring(plain, F.lit(len(folder) + 1), F.length(plain)), r"\.csv$", "")
        row_no = F.shiftleft("no", FILE_BITS) + F.col("record")
        return cells.select(*[F.col(f"cells._{head.index(c)}").alias(c) for c in wanted], source.alias("source"), row_no.alias("row_no"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows(*group, files) for group, files in usable.items()])


def read_interactions(spark: SparkSession, path: str | list[str], recursive: bool = False, skip_incomplete: bool = False) -> DataFrame:
    """Rows of all logs, with ``source`` and ``row_no`` (order in the file); texts on one line, rows without student or time dropped."""
    rows = read_csv(spark, path, INTERACTION_COLUMNS, ["student_id", "ask_time"], "log", recursive, skip_incomplete)
    return clean_interactions(rows, [c for c in ("question", "answer") if c in rows.columns])


def discover_logs(spark: SparkSession, folder: str, required: Sequence[str] = ("提问时间", "提问内容", "AI回复")) -> DataFrame:
    """(path, accepted, reason): every CSV below the folder, by its name and its header record alone, which tasks read; the driver opens no file."""
    files = records.first_records(spark, folder, recursive=True)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    head = F.transform(F.split(F.coalesce(F.decode("head", "UTF-8"), F.lit("")), ","), lambda c: F.trim(F.translate(c, '"\ufeff', "")))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), head)
    reason = F.when(name.rlike("|".join(EXCLUDED_NAMES)), "excluded name").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.concat_ws(", ", lacking)))
    return files.select(path.alias("path"), reason.isNull().alias("accepted"), reason.alias("reason"))


def read_calendar(spark: SparkSession, path: str | list[str], required: Sequence[str]) -> DataFrame:
    """A calendar with its times parsed (null where they can't be) and ``row_no``; fails at once if a column is missing."""
    rows = read_csv(spark, path, CALENDAR_COLUMNS, ["class_id", *required], "calendar").drop("source")
    return rows.withColumns({c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in _TIMES if c in rows.columns})


def load_reference(spark: SparkSession, class_windows: str, homework: str, schedule: str, schools: str | None = None, allowed: str | None = None) -> dict[str, DataFrame | None]:
    """The three calendars that are needed and the two that may be left out."""
    return {
        "class_windows": read_calendar(spark, class_windows, ["course_start", "course_end"]),
        "homework": read_calendar(spark, homework, ["release_time", "deadline_time"]),
        "schedule": read_calendar(spark, schedule, ["session_start", "session_end"]),
        "schools": read_csv(spark, schools, CALENDAR_COLUMNS, ["platform_id"], "list of schools").drop("source", "row_no") if schools else None,
        "allowed": read_csv(spark, allowed, CALENDAR_COLUMNS, ["class_id"], "list of classes").drop("source", "row_no") if allowed else None,
    }


def read_any_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8", "gb18030")) -> DataFrame:
    """(path, row, cells) of CSV files whose encoding isn't known, in splits: each file by the first encoding that all its lines can be decoded by.

    ``cells`` maps the header's names to texts; rows count from 1, empty lines included, which give no row. A byte order mark goes. A file that fits none fails.
    """
    blocks = records.survey(spark, path, encodings)
    groups: dict[tuple[tuple[str, ...], str], list[tuple[str, int]]] = defaultdict(list)
    for r in records.files_of(blocks, encodings).collect():
        if r["encoding"] is None:
            raise ValueError(f"{unquote(r['path'])} fits none of {', '.join(encodings)}")
        groups[names_of(r["head"], r["encoding"]), r["encoding"]].append((r["path"], 0))

    def rows(head: tuple[str, ...], encoding: str, files: list[tuple[str, int]]) -> DataFrame:
        found = records.parsed(records.read_records(spark, files, blocks, encoding), len(head), null_value="\x00")
        pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.col(f"cells._{head.index(name)}").alias("value")) for name in dict.fromkeys(head)])
        cells = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
        return found.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("record").alias("row"), cells.alias("cells"))

    none = spark.createDataFrame([], "path string, row long, cells map<string,string>")
    return reduce(DataFrame.unionByName, [rows(*group, files) for group, files in groups.items()], none)
