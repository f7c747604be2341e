"""Queries on segmentation, features, calendars and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.functions.text import COPY_KEYWORDS, IMAGE_MARKER, copy_keyword_count, has_image, normalize_text, preview
from dialogmill.functions.time import teaching_week, total_weeks
from dialogmill.jobs import fixtures as fx
from dialogmill.jobs.registry import query
from dialogmill.operators import audit, features, segment
from dialogmill.operators.calendar import calendar_lookups, calendar_search, with_distances
from dialogmill.operators.clean import clean_interactions as clean

KEY = "student_id, dialog_no"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("dialog_segments", f"WITH {fx.I_SQL}, {fx.segments_sql(15)} SELECT student_id, row_no, dialog_no FROM d")
def dialog_segments(spark, sf_dir):
    return segment.segment_dialogs(fx.interactions(spark, sf_dir), 15).select("student_id", "row_no", "dialog_no")


@query("dialog_segments_12h", f"{fx.D_SQL} SELECT student_id, row_no, dialog_no FROM d")
def dialog_segments_12h(spark, sf_dir):
    return fx.dialogs(spark, sf_dir).select("student_id", "row_no", "dialog_no")


@query("split_by_entrance", f"WITH {fx.I_SQL}, {fx.segments_sql(0, by_gap=False, number='chunk_no')} SELECT student_id, row_no, chunk_no FROM d")
def split_by_entrance(spark, sf_dir):
    return segment.split_by_entrance(fx.interactions(spark, sf_dir)).select("student_id", "row_no", "chunk_no")


@query("split_by_gap", f"WITH {fx.I_SQL}, {fx.segments_sql(15, by_entrance=False, number='chunk_no')} SELECT student_id, row_no, chunk_no FROM d")
def split_by_gap(spark, sf_dir):
    return segment.split_by_gap(fx.interactions(spark, sf_dir), 15).select("student_id", "row_no", "chunk_no")


@query("dialogs_per_source", f"""{fx.D_SQL}, s AS (SELECT source, student_id, max(dialog_no) AS n, count(*) AS r FROM d GROUP BY ALL)
SELECT source, count(*) AS n_students, CAST(sum(n) AS BIGINT) AS n_dialogs, max(r) AS longest_student FROM s GROUP BY source""")  # fmt: skip
def dialogs_per_source(spark, sf_dir):
    return segment.dialogs_per_source(fx.dialogs(spark, sf_dir))


@query("longest_students", f"WITH {fx.I_SQL}, n AS (SELECT source, student_id, count(*) AS n_rows FROM i GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n_rows DESC, source, student_id) AS INT) AS place FROM n QUALIFY place <= 10")
def longest_students(spark, sf_dir):
    return audit.longest_students(fx.interactions(spark, sf_dir))


@query("chunk_sizes", f"WITH {fx.I_SQL}, {fx.segments_sql(0, by_gap=False, number='chunk_no')} SELECT source, student_id, chunk_no, any_value(entrance) AS entrance, count(*) AS n_rows FROM d GROUP BY source, student_id, chunk_no")
def chunk_sizes(spark, sf_dir):
    return segment.chunk_sizes(segment.split_by_entrance(fx.interactions(spark, sf_dir)))


@query("dialogs_per_student", f"{fx.D_SQL} SELECT student_id, max(dialog_no) AS n_dialogs, count(*) AS n_rows FROM d GROUP BY student_id")
def dialogs_per_student(spark, sf_dir):
    return segment.dialogs_per_student(fx.dialogs(spark, sf_dir)).select("student_id", "n_dialogs", "n_rows")


_CHUNKS = f"WITH {fx.I_SQL}, {fx.segments_sql(2880, by_entrance=False, number='chunk_no')}"


def _chunks(spark, sf_dir):
    return segment.split_by_gap(fx.interactions(spark, sf_dir), 2880)


@query("chunk_row_payload", f"""{_CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY student_id, chunk_no) AS n,
  CAST(row_number() OVER (PARTITION BY student_id, chunk_no ORDER BY ask_time, row_no) AS INT) AS row_number FROM d)
SELECT student_id, chunk_no, row_number, row_no, question[1:500] AS question FROM n WHERE n >= 3""")  # fmt: skip
def chunk_row_payload(spark, sf_dir):
    return segment.chunk_payload(_chunks(spark, sf_dir)).select("student_id", "chunk_no", "row_number", "row_no", "question")


@query("apply_session_mapping", f"""{_CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY student_id, chunk_no ORDER BY ask_time, row_no) AS k FROM d),
m AS (SELECT *, CASE WHEN row_no % 5 <> 0 AND chunk_no % 2 = 1 THEN 1 + row_no % 3 END AS given FROM n),
f AS (SELECT *, coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY student_id, chunk_no ORDER BY ask_time, row_no ROWS UNBOUNDED PRECEDING), 1) AS sid FROM m),
b AS (SELECT *, CASE WHEN k = 1 OR sid <> lag(sid) OVER (PARTITION BY student_id, chunk_no ORDER BY ask_time, row_no) THEN 1 ELSE 0 END AS b FROM f)
SELECT student_id, row_no, CAST(sum(b) OVER (PARTITION BY student_id ORDER BY ask_time, row_no ROWS UNBOUNDED PRECEDING) AS INT) AS dialog_no FROM b""")  # fmt: skip
def apply_session_mapping(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    numbered = segment.chunk_payload(chunks, min_rows=1).where("row_no % 5 <> 0 AND chunk_no % 2 = 1")
    mapping = numbered.withColumn("session_id", (1 + F.col("row_no") % 3).cast("int"))
    return segment.apply_session_mapping(chunks, mapping).select("student_id", "row_no", "dialog_no")


@query("parse_session_mapping", "SELECT event_id, CAST(1 AS INT) AS row_number, CAST(json_extract(props, '$.k') AS INT) AS session_id FROM events")
def parse_session_mapping(spark, sf_dir):
    answers = fx.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\n"), F.replace("props", F.lit('"k"'), F.lit("'1'")), F.lit("\n```")).alias("answer"))
    return segment.parse_session_mapping(answers)


@query("clean_interactions", "SELECT conv_id, turn, replace(text, chr(10), ' ') AS question FROM conversations WHERE turn <> 3")
def clean_interactions(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("conv_id").cast("string").alias("student_id"), F.when(F.col("turn") == 3, "no time").otherwise("2025-02-17 09:38:59").alias("ask_time")
    )
    return clean(rows).select("conv_id", "turn", "question")


def _per_dialog(df: DataFrame, values: dict) -> DataFrame:
    return rounded(df.groupBy("student_id", "dialog_no").agg(*[c.alias(k) for k, c in values.items()]))


@query("dialog_basic_features", f"""{fx.D_SQL}, g AS (SELECT {KEY}, count(*) AS n, (epoch_us(max(ask_time)) - epoch_us(min(ask_time))) / 60000000.0 AS span FROM d GROUP BY {KEY})
SELECT {KEY}, CAST(n AS INT) AS qa_turns, n > 1 AS is_multi_turn, round(CASE WHEN n > 1 THEN span ELSE 0.0 END, 6) AS total_time_minutes,
  round(CASE WHEN n > 1 AND span > 0 THEN span / (n - 1) ELSE 0.0 END, 6) AS avg_qa_time_minutes FROM g""")  # fmt: skip
def dialog_basic_features(spark, sf_dir):
    return _per_dialog(fx.dialogs(spark, sf_dir), features.basic())


@query("dialog_text_features", f"WITH {fx.TEXT_SQL} SELECT dialog_id, CAST(sum(length(coalesce(question, ''))) AS BIGINT) AS total_question_chars, round(avg(length(coalesce(question, ''))), 6) AS avg_question_length FROM tr GROUP BY dialog_id")
def dialog_text_features(spark, sf_dir):
    return rounded(fx.text_rows(spark, sf_dir).groupBy("dialog_id").agg(*[c.alias(k) for k, c in features.text().items()]))


_FLAG = {"is_video_unit": "视频单元", "is_discussion_unit": "讨论单元", "is_graphic_unit": "图文单元", "is_ai_task": "课堂AI任务"}
_OLD = {"is_courseware_entry": "课件不懂", "is_discussion_entry": "讨论单元", "is_ai_task_entry": "课堂AI任务", "is_exercise_entry": "习题不懂"}


@query("dialog_entry_flags", f"""{fx.D_SQL} SELECT {KEY}, CAST(bool_or(entrance IS DISTINCT FROM '班级') AS INT) AS if_non_class, {', '.join(f"CAST(bool_or(entrance = '{v}') AS INT) AS {k}" for k, v in {**_FLAG, **_OLD}.items())},
  CAST(bool_or(entrance IN ('课堂不懂', '课件不懂', '习题不懂')) AS INT) AS is_confusion_entry FROM d GROUP BY {KEY}""")  # fmt: skip
def dialog_entry_flags(spark, sf_dir):
    return _per_dialog(fx.dialogs(spark, sf_dir), {**features.entries(), **features.older_entries()})


_NORMAL = "regexp_replace(coalesce({}, ''), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{a0}}\\x{{3000}}]+', '', 'g')"


@query("normalize_text", f"SELECT doc_id, {_NORMAL.format('text')} AS normal FROM documents")
def normalized(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("normal"))


_COUNT = " + ".join(f"CAST(contains(q, '{k}') AS INT)" for k in COPY_KEYWORDS)


@query("copy_keyword_counts", f"""WITH {fx.TEXT_SQL}, n AS (SELECT dialog_id, entrance, question, {_NORMAL.format('question')} AS q FROM tr),
k AS (SELECT dialog_id, entrance, {_COUNT} + len(regexp_extract_all(q, '[0-9]+分')) AS k, CAST(contains(coalesce(question, ''), '{IMAGE_MARKER}') AS INT) AS pic FROM n),
s AS (SELECT dialog_id, CAST(sum(k) + CASE WHEN bool_or(entrance IN ('课堂不懂', '课件不懂', '习题不懂')) THEN 0 ELSE sum(pic) END AS BIGINT) AS copy_keywords_count FROM k GROUP BY dialog_id)
SELECT dialog_id, copy_keywords_count, CAST(copy_keywords_count > 0 AS INT) AS is_copy_paste FROM s""")  # fmt: skip
def copy_keyword_counts(spark, sf_dir):
    rows = features.with_text_marks(fx.text_rows(spark, sf_dir))
    return rows.groupBy("dialog_id").agg(*[c.alias(k) for k, c in features.copy_signs().items()])


@query("copy_keyword_rows", f"WITH {fx.TEXT_SQL}, n AS (SELECT dialog_id, row_no, question, {_NORMAL.format('question')} AS q FROM tr) SELECT dialog_id, row_no, CAST({_COUNT} + len(regexp_extract_all(q, '[0-9]+分')) AS INT) AS n_keywords, contains(coalesce(question, ''), '{IMAGE_MARKER}') AS has_image FROM n")
def copy_keyword_rows(spark, sf_dir):
    q = F.col("question")
    return fx.text_rows(spark, sf_dir).select("dialog_id", "row_no", copy_keyword_count(normalize_text(q)).alias("n_keywords"), has_image(q).alias("has_image"))


@query("why_flag", f"WITH {fx.TEXT_SQL} SELECT dialog_id, CAST(bool_or(regexp_matches(coalesce(question, ''), '为什么|为啥|为何|因为什么|怎么会|怎么还|是因为|原因是什么|原因是啥|导致了什么|造成了什么|怎么造成|怎么出现|怎么变成')) AS INT) AS question_type_why FROM tr GROUP BY dialog_id")
def why_flag(spark, sf_dir):
    return fx.text_rows(spark, sf_dir).groupBy("dialog_id").agg(features.why().alias("question_type_why"))


@query("text_preview", "SELECT doc_id, text[1:80] AS preview FROM documents")
def text_preview(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def _looked(spark, sf_dir):
    return with_distances(calendar_lookups(fx.dialogs(spark, sf_dir), fx.schedule(spark, sf_dir), fx.homework(spark, sf_dir)))


def _lookups_sql(source: str = "i", more: str = "") -> str:
    """SQL of the calendar lookups of the rows in ``source``; ``more``: tables before them."""
    return f"""{fx.D_SQL}, {fx.SCHEDULE_SQL}, {fx.HOMEWORK_SQL}, {more}
q AS (SELECT class_id, row_no, ask_time, epoch_us(ask_time) AS t FROM {source}),
st AS (SELECT DISTINCT class_id, session_start AS x FROM sc), en AS (SELECT DISTINCT class_id, session_end AS x FROM sc),
re AS (SELECT DISTINCT class_id, release_time AS x FROM hw), de AS (SELECT DISTINCT class_id, deadline_time AS x FROM hw),
l1 AS (SELECT q.*, st.x AS ns FROM q ASOF LEFT JOIN st ON q.class_id = st.class_id AND q.ask_time < st.x),
l2 AS (SELECT l1.*, en.x AS le FROM l1 ASOF LEFT JOIN en ON l1.class_id = en.class_id AND l1.ask_time > en.x),
l3 AS (SELECT l2.*, de.x AS nd FROM l2 ASOF LEFT JOIN de ON l2.class_id = de.class_id AND l2.ask_time < de.x),
l4 AS (SELECT l3.*, re.x AS lr FROM l3 ASOF LEFT JOIN re ON l3.class_id = re.class_id AND l3.ask_time >= re.x),
l5 AS (SELECT l4.*, st.x AS ls FROM l4 ASOF LEFT JOIN st ON l4.class_id = st.class_id AND l4.ask_time >= st.x),
h AS (SELECT row_no, class_id, coalesce((epoch_us(ns) - t) / 3600000000.0, 168.0) AS hours_to_next_class, coalesce((t - epoch_us(le)) / 3600000000.0, 168.0) AS hours_from_last_class,
  least(coalesce((epoch_us(nd) - t) / 3600000000.0, 720.0), 720.0) AS hours_to_assignment, least(coalesce((t - epoch_us(lr)) / 3600000000.0, 720.0), 720.0) AS hours_since_release,
  CAST(coalesce(ls + INTERVAL 90 MINUTE >= ask_time, false) AS INT) AS in_class_time FROM l5)"""


_ROWS = _lookups_sql()


def _hours(name: str):
    @query(name, f"{_ROWS} SELECT row_no, round({name}, 6) AS {name} FROM h")
    def job(spark, sf_dir, name=name):
        return rounded(_looked(spark, sf_dir).select("row_no", name))

    return job


for _name in ("hours_to_next_class", "hours_from_last_class", "hours_to_assignment", "hours_since_release"):
    _hours(_name)


@query("calendar_search", f"""{_ROWS} SELECT row_no, round(hours_to_next_class, 6) AS hours_to_next_class, round(hours_from_last_class, 6) AS hours_from_last_class,
  round(hours_to_assignment, 6) AS hours_to_assignment, round(hours_since_release, 6) AS hours_since_release, in_class_time FROM h""")  # fmt: skip
def calendar_search_all(spark, sf_dir):
    """All five lookups by binary search; the queries above go through windows."""
    found = with_distances(calendar_search(fx.dialogs(spark, sf_dir), fx.schedule(spark, sf_dir), fx.homework(spark, sf_dir)))
    names = ("hours_to_next_class", "hours_from_last_class", "hours_to_assignment", "hours_since_release", "in_class_time")
    return rounded(found.select("row_no", *names))


@query("in_class_time", f"{_ROWS} SELECT row_no, in_class_time FROM h")
def in_class_time(spark, sf_dir):
    return _looked(spark, sf_dir).select("row_no", "in_class_time")


@query("dialog_time_features", f"""{_ROWS} SELECT d.student_id, d.dialog_no, round(avg(hours_to_assignment), 6) AS avg_hours_to_assignment, round(avg(hours_since_release), 6) AS avg_hours_since_release,
  round(avg(hours_to_next_class), 6) AS hours_to_next_class, round(avg(hours_from_last_class), 6) AS hours_from_last_class, max(in_class_time) AS is_in_class_time FROM d JOIN h USING (row_no) GROUP BY d.student_id, d.dialog_no""")  # fmt: skip
def dialog_time_features(spark, sf_dir):
    return _per_dialog(_looked(spark, sf_dir), features.distances())


_WEEK = "CASE WHEN ask_time >= course_start AND ask_time <= course_end THEN CAST(greatest(1, floor((epoch_us(ask_time) - epoch_us(course_start)) / 604800000000.0) + 1) AS INT) ELSE -1 END"
_WEEKS = "greatest(1, floor((epoch_us(course_end) - epoch_us(course_start)) / 604800000000.0) + 1)"


def _in_weeks(spark, sf_dir):
    rows = fx.dialogs(spark, sf_dir).join(features.first_windows(fx.class_windows(spark, sf_dir)), "class_id")
    return rows.withColumn("week", teaching_week(F.col("ask_time"), F.col("course_start"), F.col("course_end")))


@query("teaching_week", f"WITH {fx.I_SQL}, {fx.WINDOWS_SQL} SELECT row_no, {_WEEK} AS week FROM i JOIN cw USING (class_id)")
def teaching_weeks(spark, sf_dir):
    return _in_weeks(spark, sf_dir).select("row_no", "week")


@query("course_progress", f"""{fx.D_SQL}, {fx.WINDOWS_SQL}, w AS (SELECT d.*, {_WEEK} AS week, {_WEEKS} AS weeks FROM d JOIN cw USING (class_id))
SELECT {KEY}, round(avg(week / weeks), 6) AS course_progress_ratio, CAST(arg_min(week, ask_time) >= max(weeks) - 1 AS INT) AS is_exam_week FROM w WHERE weeks IS NOT NULL
GROUP BY {KEY} HAVING min(week) > 0""")  # fmt: skip
def course_progress(spark, sf_dir):
    weeks = total_weeks(F.col("course_start"), F.col("course_end"))
    rows = _in_weeks(spark, sf_dir).where("course_end IS NOT NULL").groupBy("student_id", "dialog_no")
    out = rows.agg(F.avg(F.col("week") / weeks).alias("course_progress_ratio"), (F.min_by("week", "ask_time") >= F.max(weeks) - 1).cast("int").alias("is_exam_week"), F.min("week").alias("least"))
    return rounded(out.where("least > 0").drop("least"))


@query("calendar_week", f"{fx.D_SQL} SELECT {KEY}, CAST(floor(date_diff('day', DATE '2025-02-17', CAST(min(ask_time) AS DATE)) / 7.0) + 1 AS INT) AS calendar_week_since_2025_0217 FROM d GROUP BY {KEY}")
def calendar_weeks(spark, sf_dir):
    return _per_dialog(fx.dialogs(spark, sf_dir), {"calendar_week_since_2025_0217": features.clock(F.min("ask_time"))["calendar_week_since_2025_0217"]})


@query("clock_features", f"{fx.D_SQL} SELECT {KEY}, round(hour(min(ask_time)) + minute(min(ask_time)) / 60.0, 6) AS day_period, CAST(isodow(min(ask_time)) >= 6 AS INT) AS is_weekend FROM d GROUP BY {KEY}")
def clock_features(spark, sf_dir):
    clock = features.clock(F.min("ask_time"))
    return _per_dialog(fx.dialogs(spark, sf_dir), {k: clock[k] for k in ("day_period", "is_weekend")})


_SPANS = f"{fx.D_SQL}, {fx.WINDOWS_SQL}, s AS (SELECT {KEY}, arg_min(class_id, row_no) AS class_id, min(ask_time) AS lo, max(ask_time) AS hi FROM d GROUP BY {KEY})"


@query("dialogs_in_window", f"{_SPANS} SELECT {KEY}, s.class_id, lo AS first_time, hi AS last_time FROM s JOIN cw USING (class_id) WHERE lo >= course_start AND hi <= course_end")
def dialogs_in_window(spark, sf_dir):
    return audit.dialogs_in_window(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir)).select("student_id", "dialog_no", "class_id", "first_time", "last_time")


_ALLOWED = "al AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS class_id FROM nation WHERE n_nationkey <> 3)"


def _allowed(spark, sf_dir):
    return fx.table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("class_id"))


@query("class_allowlist", f"WITH {fx.I_SQL}, {_ALLOWED} SELECT row_no, class_id FROM i WHERE class_id IN (SELECT class_id FROM al)")
def class_allowlist(spark, sf_dir):
    return audit.allow_classes(fx.interactions(spark, sf_dir), _allowed(spark, sf_dir)).select("row_no", "class_id")


@query("dialog_outcome_stats", f"""{_SPANS}, {_ALLOWED}, o AS (SELECT CASE WHEN s.class_id NOT IN (SELECT class_id FROM al) THEN 'filtered_by_class_info' WHEN cw.class_id IS NULL THEN 'no_class_info'
  WHEN course_start IS NULL OR course_end IS NULL THEN 'invalid_window' WHEN lo < course_start OR hi > course_end THEN 'out_of_range' ELSE 'processed' END AS outcome FROM s LEFT JOIN cw USING (class_id))
SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in audit.OUTCOMES)}, round(count(*) FILTER (WHERE outcome = 'processed') / greatest(count(*), 1), 6) AS success_ratio,
  round(count(*) FILTER (WHERE outcome = 'out_of_range') / greatest(count(*), 1), 6) AS out_of_range_ratio, round(count(*) FILTER (WHERE outcome NOT IN ('processed', 'out_of_range')) / greatest(count(*), 1), 6) AS fail_ratio FROM o""")  # fmt: skip
def dialog_outcome_stats(spark, sf_dir):
    return audit.outcome_stats(audit.dialog_outcomes(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir), _allowed(spark, sf_dir)))


@query("class_presence_split", f"{_SPANS} SELECT {KEY}, class_id, class_id IN (SELECT class_id FROM cw) AS present FROM s")
def class_presence_split(spark, sf_dir):
    return audit.class_presence(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir)).select("student_id", "dialog_no", "class_id", "present")


@query("range_audit", f"""{_SPANS} SELECT {KEY}, CASE WHEN course_start IS NULL OR course_end IS NULL THEN 'no_class_info' WHEN hi < course_start THEN 'before' WHEN lo > course_end THEN 'after' ELSE 'in_range' END AS status,
  CAST(course_start IS NULL OR course_end IS NULL AS BIGINT) AS classes_unknown FROM s LEFT JOIN cw USING (class_id)""")  # fmt: skip
def range_audit(spark, sf_dir):
    return audit.range_audit(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir)).select("student_id", "dialog_no", "status", "classes_unknown")


_QUESTION_HITS = f"{_COUNT} + len(regexp_extract_all(q, '[0-9]+分'))"


def _features_sql(rows: str = "i", source: str = "d", more: str = "") -> str:
    """SQL of all features of the dialogs in ``source``, whose rows are also those of ``rows``; ``more``: tables before them."""
    return f"""{_lookups_sql(rows, more)}, {fx.WINDOWS_SQL}, x AS (SELECT d.*, h.* EXCLUDE (row_no, class_id), {_NORMAL.format('question')} AS q, {_WEEK} AS week, {_WEEKS} AS weeks, course_start, course_end FROM {source} d JOIN h USING (row_no) JOIN cw ON d.class_id = cw.class_id),
y AS (SELECT *, {_QUESTION_HITS} AS k FROM x),
g AS (SELECT {KEY}, arg_min(class_id, row_no) AS class_id, count(*) AS n, (epoch_us(max(ask_time)) - epoch_us(min(ask_time))) / 60000000.0 AS span, min(ask_time) AS t, CAST(sum(length(question)) AS BIGINT) AS total_question_chars, avg(length(question)) AS avg_question_length,
  CAST(bool_or(entrance <> '班级') AS INT) AS if_non_class, {', '.join(f"CAST(bool_or(entrance = '{v}') AS INT) AS {k}" for k, v in _FLAG.items())}, CAST(bool_or(entrance IN ('课堂不懂', '课件不懂', '习题不懂')) AS INT) AS is_confusion_entry,
  CAST(sum(k) AS BIGINT) AS copy_keywords_count, avg(hours_to_assignment) AS avg_hours_to_assignment, avg(hours_since_release) AS avg_hours_since_release, avg(hours_to_next_class) AS hours_to_next_class, avg(hours_from_last_class) AS hours_from_last_class,
  max(in_class_time) AS is_in_class_time, avg(week / weeks) AS course_progress_ratio, CAST(arg_min(week, ask_time) >= max(weeks) - 1 AS INT) AS is_exam_week FROM y GROUP BY {KEY} HAVING min(ask_time) >= min(course_start) AND max(ask_time) <= max(course_end))
SELECT {KEY}, class_id, CAST(n AS INT) AS qa_turns, n > 1 AS is_multi_turn, round(CASE WHEN n > 1 THEN span ELSE 0.0 END, 6) AS total_time_minutes, round(CASE WHEN n > 1 AND span > 0 THEN span / (n - 1) ELSE 0.0 END, 6) AS avg_qa_time_minutes,
  total_question_chars, round(avg_question_length, 6) AS avg_question_length, if_non_class, {', '.join(_FLAG)}, is_confusion_entry, copy_keywords_count, CAST(copy_keywords_count > 0 AS INT) AS is_copy_paste,
  round(avg_hours_to_assignment, 6) AS avg_hours_to_assignment, round(avg_hours_since_release, 6) AS avg_hours_since_release, round(hours_to_next_class, 6) AS hours_to_next_class, round(hours_from_last_class, 6) AS hours_from_last_class, is_in_class_time,
  round(course_progress_ratio, 6) AS course_progress_ratio, CAST(floor(date_diff('day', DATE '2025-02-17', CAST(t AS DATE)) / 7.0) + 1 AS INT) AS calendar_week_since_2025_0217, round(hour(t) + minute(t) / 60.0, 6) AS day_period, CAST(isodow(t) >= 6 AS INT) AS is_weekend,
  is_exam_week, CAST(0 AS INT) AS question_type_why FROM g"""


@query("dialog_features", _features_sql())
def dialog_features(spark, sf_dir):
    found = features.extract_features(fx.dialogs(spark, sf_dir), fx.class_windows(spark, sf_dir), fx.schedule(spark, sf_dir), fx.homework(spark, sf_dir))
    return rounded(found.drop("source"))


def _broken(rows):
    """Some dialogs with a row of another class or without a time."""
    row, last = F.col("row_no"), F.col("row_no") == F.max("row_no").over(Window.partitionBy("source", "student_id", "dialog_no"))
    return rows.withColumns({
        "class_id": F.when(last & (row % 3 == 0), "7").otherwise(F.col("class_id")),
        "ask_time": F.when(row % 41 != 0, F.col("ask_time")),
    })


_BROKEN = """bx AS (SELECT * REPLACE (CASE WHEN row_no = max(row_no) OVER k AND row_no % 3 = 0 THEN '7' ELSE class_id END AS class_id, CASE WHEN row_no % 41 <> 0 THEN ask_time END AS ask_time)
  FROM d WINDOW k AS (PARTITION BY student_id, dialog_no)),
bs AS (SELECT student_id, dialog_no, arg_min(class_id, row_no) AS class_id, bool_or(ask_time IS NULL) AS bad FROM bx GROUP BY ALL),
"""


@query("dialog_features_mixed", _features_sql("bd", "bd", _BROKEN + "bd AS (SELECT bx.* REPLACE (bs.class_id AS class_id) FROM bx JOIN bs USING (student_id, dialog_no) WHERE NOT bad),"))
def dialog_features_mixed(spark, sf_dir):
    """The first row's class holds for its dialog, and a missing time refuses it."""
    found = features.extract_features(_broken(fx.dialogs(spark, sf_dir)), fx.class_windows(spark, sf_dir), fx.schedule(spark, sf_dir), fx.homework(spark, sf_dir))
    return rounded(found.drop("source"))


@query("dialog_outcomes_mixed", f"""{fx.D_SQL}, {fx.WINDOWS_SQL}, {_BROKEN}bl AS (SELECT student_id, dialog_no, min(ask_time) AS lo, max(ask_time) AS hi FROM bx GROUP BY ALL)
SELECT student_id, dialog_no, bs.class_id, CASE WHEN bad THEN 'invalid_times' WHEN cw.class_id IS NULL THEN 'no_class_info' WHEN course_start IS NULL OR course_end IS NULL THEN 'invalid_window' WHEN lo < course_start OR hi > course_end THEN 'out_of_range' ELSE 'processed' END AS outcome
FROM bs JOIN bl USING (student_id, dialog_no) LEFT JOIN cw ON bs.class_id = cw.class_id""")  # fmt: skip
def dialog_outcomes_mixed(spark, sf_dir):
    found = audit.dialog_outcomes(_broken(fx.dialogs(spark, sf_dir)), fx.class_windows(spark, sf_dir))
    return found.select("student_id", "dialog_no", "class_id", "outcome")
