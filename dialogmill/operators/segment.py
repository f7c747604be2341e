"""From interaction rows to dialogs: entrance changes, time gaps, and mappings that are given from outside.

All steps order a student's rows by (ask_time, row_no). A student's line is one sorted group as long as it holds a small share of
all rows; the lines of busy students are cut into pieces by time, which are gone through side by side: a small table carries the last row of a
piece and the number of boundaries before it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from dialogmill.functions.time import micros
from dialogmill.tables import discard, same, written

STUDENT = ("source", "student_id")
#: A student with more than one of so many parts of all rows is busy, and is cut into as many pieces.
PIECES = 1024
#: Cuts are looked up in two steps: every ``STEP``-th first.
STEP = 32


def _line(*by: str) -> WindowSpec:
    return Window.partitionBy(*(by or STUDENT)).orderBy("ask_time", "row_no")


def busy_cuts(rows: DataFrame, busy_rows: int) -> DataFrame | None:
    """(source, student_id, __cuts) of each busy student: the times between its pieces, which have about equally many rows; None if nobody is busy.

    At most ``PIECES`` students can hold more than one of ``PIECES`` parts, so the table is bounded however many rows there are.
    """
    sizes = rows.groupBy(*STUDENT).agg(F.count(F.lit(1)).alias("__n"))
    total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(busy_rows, (total or 0) // PIECES)
    if most is None or most <= limit:
        return None
    busy = sizes.where(F.col("__n") > limit).select(*STUDENT)
    shares = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    cuts = F.percentile_approx(micros(F.col("ask_time")), shares, 10 * PIECES)
    narrow = rows.select(*STUDENT, "ask_time")
    return written(same(narrow, F.broadcast(busy), STUDENT).groupBy(*STUDENT).agg(F.coalesce(cuts, F.array().cast("array<bigint>")).alias("__cuts")), "cuts")


def _piece(us: Column, cuts: Column) -> Column:
    """Number of cuts before a time; 0 without cuts, and -1, before all others, without a time."""
    every = F.filter(cuts, lambda c, k: (k % STEP == STEP - 1) & (c < us))
    coarse = F.size(every) * STEP
    fine = F.size(F.filter(F.slice(cuts, coarse + 1, F.lit(STEP)), lambda c: c < us))
    return F.when(cuts.isNull(), 0).when(us.isNull(), -1).otherwise(coarse + fine)


def _numbered(rows: DataFrame, opens: Callable[[Callable[[str], Column]], Column], out: str, busy_rows: int) -> DataFrame:
    """Number of the run that a row belongs to; ``opens`` tells from the entrance or time of the row before, which it may ask for, whether it opens one."""
    cuts = busy_cuts(rows, busy_rows)
    if cuts is None:
        start = (F.row_number().over(_line()) == 1) | opens(lambda c: F.lag(c).over(_line()))
        started = rows.withColumn("__start", F.when(start, 1).otherwise(0))
        return started.withColumn(out, F.sum("__start").over(_line()).cast("int")).drop("__start")

    cut = same(rows, F.broadcast(cuts), STUDENT, "left")
    cut = cut.withColumns({"__who": F.struct(*STUDENT), "__piece": _piece(micros(F.col("ask_time")), F.col("__cuts"))}).drop("__cuts")
    known = [c for c in ("entrance", "ask_time") if c in rows.columns]
    last = F.max_by(F.struct(*known), F.struct("ask_time", "row_no")).alias("__last")
    ends = cut.groupBy("__who", "__piece").agg(last)
    pieces = Window.partitionBy("__who").orderBy("__piece")  # a row for each piece
    carried = written(ends.select("__who", "__piece", F.lag("__last").over(pieces).alias("__prior")), "carried")

    def marked(df: DataFrame) -> DataFrame:
        line = _line("__who", "__piece")
        head = F.row_number().over(line) == 1
        prior = lambda c: F.when(head, F.col("__prior")[c]).otherwise(F.lag(c).over(line))
        start = (head & F.col("__prior").isNull()) | opens(prior)
        return df.withColumn("__start", F.when(start, 1).otherwise(0))

    counts = marked(cut.join(carried, ["__who", "__piece"])).groupBy("__who", "__piece").agg(F.sum("__start").alias("__n"))
    offset = (F.sum("__n").over(pieces) - F.col("__n")).alias("__offset")
    tables = carried.join(counts.select("__who", "__piece", offset), ["__who", "__piece"])
    counted = written(tables, "carried")
    discard(carried)
    numbered = marked(cut.join(counted, ["__who", "__piece"]))
    number = F.col("__offset") + F.sum("__start").over(_line("__who", "__piece"))
    return numbered.withColumn(out, number.cast("int")).drop("__who", "__piece", "__prior", "__offset", "__start")


def entrance_changed(before: Column) -> Column:
    return ~F.col("entrance").eqNullSafe(before)


def gap_exceeded(before: Column, minutes: float) -> Column:
    return F.coalesce(micros(F.col("ask_time")) - micros(before) > int(minutes * 60_000_000), F.lit(False))


#: Rows from which on a student can be busy: fewer are one group of any task.
BUSY_ROWS = 1_000_000


def split_by_entrance(rows: DataFrame, out: str = "chunk_no", busy_rows: int = BUSY_ROWS) -> DataFrame:
    """A new chunk wherever the entrance differs from the row before."""
    return _numbered(rows, lambda before: entrance_changed(before("entrance")), out, busy_rows)


def split_by_gap(rows: DataFrame, minutes: float = 15, out: str = "chunk_no", busy_rows: int = BUSY_ROWS) -> DataFrame:
    """A new chunk after a pause of more than ``minutes``."""
    return _numbered(rows, lambda before: gap_exceeded(before("ask_time"), minutes), out, busy_rows)


def segment_dialogs(rows: DataFrame, minutes: float = 15, out: str = "dialog_no", busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Both rules in one pass: a chunk's first row is a boundary anyway."""
    return _numbered(rows, lambda before: entrance_changed(before("entrance")) | gap_exceeded(before("ask_time"), minutes), out, busy_rows)


def dialog_id(number: str = "dialog_no") -> Column:
    return F.concat_ws("_", *STUDENT, number)


def chunk_payload(chunks: DataFrame, min_rows: int = 3, text_size: int = 500) -> DataFrame:
    """Numbered rows of all chunks of at least ``min_rows``: what an outside labeller is given."""
    chunk = Window.partitionBy(*STUDENT, "chunk_no")
    return (
        chunks.withColumn("__n", F.count(F.lit(1)).over(chunk))
        .where(F.col("__n") >= min_rows)
        .withColumn("row_number", F.row_number().over(chunk.orderBy("ask_time", "row_no")))
        .select(*STUDENT, "chunk_no", "row_number", "row_no", "ask_time", F.substring("question", 1, text_size).alias("question"), F.substring("answer", 1, text_size).alias("answer"))
    )


def payload_json(payload: DataFrame) -> DataFrame:
    """The payload as one JSON array per chunk."""
    row = F.struct("row_number", F.col("ask_time").cast("string").alias("timestamp"), "question", "answer")
    return payload.groupBy(*STUDENT, "chunk_no").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))


def parse_session_mapping(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(..., row_number, session_id) of a labeller's answers: a JSON object, or an array counted from 1.

    Code fences go, single quotes, bare names, comments and a trailing comma pass; what isn't an integer is left out.
    """
    clean = F.trim(F.regexp_replace(F.trim(F.col(text)), r"(?m)^```(?:json)?|```$", ""))
    clean = F.regexp_replace(clean, r",\s*([}\]])", "$1")
    lenient = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowComments": "true", "mode": "PERMISSIVE"}
    as_object = F.from_json(clean, "map<string,string>", lenient)
    as_array = F.from_json(clean, "array<string>", lenient)
    listed = F.map_from_arrays(F.transform(as_array, lambda _, k: (k + 1).cast("string")), as_array)
    pairs = F.when(clean.startswith("["), listed).otherwise(as_object)
    keys = [c for c in answers.columns if c != text]
    return (
        answers.select(*keys, F.explode(pairs).alias("__key", "__value"))
        .select(*keys, F.col("__key").try_cast("int").alias("row_number"), F.col("__value").try_cast("int").alias("session_id"))
        .where("row_number IS NOT NULL AND session_id IS NOT NULL")
    )


def apply_session_mapping(chunks: DataFrame, mapping: DataFrame, out: str = "dialog_no", busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Splits chunks by given session ids, keyed (source, student_id, chunk_no, row_number).

    A chunk without any mapping stays whole; a row without one takes that of the row before, at first 1; every change
    of the id opens a dialog. Dialogs are numbered along the student.
    """
    chunk = Window.partitionBy(*STUDENT, "chunk_no").orderBy("ask_time", "row_no")
    key = [*STUDENT, "chunk_no", "row_number"]
    labelled = chunks.withColumn("row_number", F.row_number().over(chunk)).join(mapping.select(*key, "session_id"), key, "left")
    held = F.coalesce(F.last("session_id", ignorenulls=True).over(chunk.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    labelled = labelled.withColumn("session_id", held)
    changed = (F.col("row_number") == 1) | (F.col("session_id") != F.lag("session_id").over(chunk))
    return _numbered(labelled.withColumn("__opens", changed), lambda _: F.col("__opens"), out, busy_rows).drop("__opens")


def dialogs_per_student(dialogs: DataFrame) -> DataFrame:
    return dialogs.groupBy(*STUDENT).agg(F.max("dialog_no").alias("n_dialogs"), F.count(F.lit(1)).alias("n_rows"))


def dialogs_per_source(dialogs: DataFrame) -> DataFrame:
    return dialogs_per_student(dialogs).groupBy("source").agg(F.count(F.lit(1)).alias("n_students"), F.sum("n_dialogs").alias("n_dialogs"), F.max("n_rows").alias("longest_student"))


def chunk_sizes(chunks: DataFrame, by: str = "chunk_no") -> DataFrame:
    """(source, student_id, chunk_no, entrance, n_rows): each chunk's entrance, that of its first row, and its size."""
    return chunks.groupBy(*STUDENT, by).agg(F.min_by("entrance", F.struct("ask_time", "row_no")).alias("entrance"), F.count(F.lit(1)).alias("n_rows"))
