"""Records of quoted CSV files that are read in splits: cells may hold line breaks, and no task reads a whole file.

Files are read as lines of bytes, split wherever Spark likes. Whether a line begins inside a quoted cell follows from the lines before it,
so every block of a file first tells what it does to either state; from these, a small table of blocks, each block's
true state and the number of records before it are worked out, and then the lines are put together to records, which Spark's own parser takes.
A line feed or a quote is never part of another character in UTF-8 or GB18030, so bytes are enough; the encoding is settled for each
file by whether all its lines can be decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.tables import ship_package, written

BOM = b"\xef\xbb\xbf"
OUT, IN = 0, 1


def after_line(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind a line. A quote opens a cell only where the cell begins, and is doubled inside it."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == 0x22:
                inside, at = True, at + 1
            else:
                comma = line.find(b",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        at = line.find(b'"', at)
        if at < 0:
            return True
        if at + 1 < n and line[at + 1] == 0x22:
            at += 2
            continue
        comma = line.find(b",", at + 1)  # what stands behind a closing quote belongs to the cell
        if comma < 0:
            return False
        inside, at = False, comma + 1


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, block, value): the lines of all CSV files as bytes, in order within a block; ``path`` as Spark's metadata has it."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv")
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """The lines of each block in a batch; a carriage return at the end and the mark at the start of a file go."""
    paths, blocks = batch.column(0), batch.column(1).to_numpy()
    codes = paths.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for start, end in zip([0, *edges], [*edges, len(batch)], strict=True):
        if end > start:
            lines = [v[:-1] if v.endswith(b"\r") else v for v in batch.column(2).slice(start, end - start).to_pylist()]
            yield (paths[int(start)].as_py(), int(blocks[start])), lines


def _states(lines: list[bytes], state: int) -> np.ndarray:
    """The state before each line and behind the last, from that before the first."""
    states, start = np.empty(len(lines) + 1, np.int32), 0
    for k, line in enumerate(lines):
        if b'"' in line:
            states[start : k + 1] = state
            state, start = int(after_line(line, bool(state))), k + 1
    states[start:] = state
    return states


def _decodes(lines: list[bytes], encoding: str) -> bool:
    try:
        b"\n".join(lines).decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def survey(spark: SparkSession, path: str | list[str], encodings: Sequence[str] = ("utf-8",), recursive: bool = False) -> DataFrame:
    """A written row for each block: (path, block, ends, starts, fits, head).

    ``ends`` and ``starts`` have two values each, for a block that begins outside and inside a quoted cell: whether it ends inside one, and how
    many records start in it. ``fits`` tells for each encoding whether all lines can be decoded, ``head`` is the file's first record.
    """
    ship_package(spark)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, starts, fits, head = None, [OUT, IN], [0, 0], [], []

        def told() -> pa.RecordBatch:
            values = [key[0], key[1], ends, starts, fits, b"\n".join(head) if key[1] == 0 else None]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], names=shape.names)

        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    if key is not None:
                        yield told()
                    key, ends, starts, fits, head, whole = own, [OUT, IN], [0, 0], [True] * len(encodings), [], False
                    lines[0] = lines[0].removeprefix(BOM) if own[1] == 0 else lines[0]
                fits = [f and _decodes(lines, e) for f, e in zip(fits, encodings, strict=True)]
                states = [_states(lines, state) for state in ends]
                if not whole:
                    closed = np.flatnonzero(states[OUT][1:] == OUT)
                    head += lines[: closed[0] + 1] if len(closed) else lines
                    whole = len(closed) > 0
                starts = [n + int((s[:-1] == OUT).sum()) for n, s in zip(starts, states, strict=True)]
                ends = [int(s[-1]) for s in states]
        if key is not None:
            yield told()

    shape = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("fits", pa.list_(pa.bool_())), ("head", pa.binary()),
    ])
    lines = read_lines(spark, path, recursive)
    found = lines.mapInArrow(sum_up, "path string, block long, ends array<int>, starts array<long>, fits array<boolean>, head binary")
    return written(found, "blocks")


def files_of(blocks: DataFrame, encodings: Sequence[str] = ("utf-8",)) -> DataFrame:
    """(path, encoding, head): of each file the first of the encodings that fits all its blocks (null if none does) and its first record."""
    fitting = [F.when(F.bool_and(F.get("fits", F.lit(k))), e) for k, e in enumerate(encodings)]
    return blocks.groupBy("path").agg(F.coalesce(*fitting).alias("encoding"), F.max("head").alias("head"))


def entered(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, no, block, state, before) of the blocks of some files (path, no): whether a block begins inside a quoted cell, and how many records of its file start before it.

    What a block does to the state is to set it, keep it or turn it; so the state is that set last, turned as often as blocks since then
    turn it. The windows are over a file's blocks, a row for each.
    """
    up_to = Window.partitionBy("path").orderBy("block")
    earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = F.get("ends", F.lit(OUT)), F.get("ends", F.lit(IN))
    turn = F.when((outside == IN) & (inside == OUT), 1).otherwise(0)
    turned = blocks.join(files, "path").withColumn("turn", turn).withColumn("turns", F.sum("turn").over(up_to))
    fixed = F.last(F.when(outside == inside, F.struct(outside.alias("to"), "turns")), ignorenulls=True).over(earlier)
    told = turned.withColumns({"fixed": fixed, "so_far": F.coalesce(F.sum("turn").over(earlier), F.lit(0))})
    since = F.col("so_far") - F.coalesce("fixed.turns", F.lit(0))
    state = F.pmod(F.coalesce("fixed.to", F.lit(OUT)) + since, F.lit(2)).cast("int")
    counted = told.withColumn("state", state).withColumn("own", F.element_at("starts", F.col("state") + 1))
    return counted.select("path", "no", "block", "state", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))


def _marked(lines: DataFrame, encoding: str) -> DataFrame:
    """Adds to each line, decoded, its number in the block, and for either state of the block its own state, that behind it, and its record's number in the block."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, records, number = None, [OUT, IN], [-1, -1], 0
        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    key, states, records, number = own, [OUT, IN], [-1, -1], 0
                    lines[0] = lines[0].removeprefix(BOM) if own[1] == 0 else lines[0]
                columns: list = []
                for entry in (OUT, IN):
                    before = _states(lines, states[entry])
                    record = records[entry] + np.cumsum(before[:-1] == OUT)
                    states[entry], records[entry] = int(before[-1]), int(record[-1])
                    columns += [before[:-1], before[1:], record]
                numbers = np.arange(number, number + len(lines))
                number += len(lines)
                text = pa.array([line.decode(encoding, "replace") for line in lines], pa.string())
                out_key = [pa.array([key[0]] * len(lines), pa.string()), pa.array(np.full(len(lines), key[1], np.int64))]
                yield pa.RecordBatch.from_arrays([*out_key, pa.array(numbers), text, *(pa.array(np.ascontiguousarray(c)) for c in columns)], names)

    names = ["path", "block", "line", "text", "s0", "e0", "r0", "s1", "e1", "r1"]
    kinds = "path string, block long, line long, text string, s0 int, e0 int, r0 long, s1 int, e1 int, r1 long"
    return lines.mapInArrow(mark, kinds)


def read_records(spark: SparkSession, files: Sequence[tuple[str, int]], blocks: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, no, record, text): the records of some files (path, no), counted from 0 in each (the first is the header), their lines joined by line feeds.

    Records of one line, nearly all, stay where they were read; only the lines of others are shuffled. Empty lines between records are left
    out but counted. Bytes that the encoding doesn't have become U+FFFD.
    """
    ship_package(spark)
    marked = _marked(read_lines(spark, [as_pattern(path) for path, _ in files]), encoding)
    placed = marked.join(entered(blocks, spark.createDataFrame(list(files), "path string, no long")), ["path", "block"])

    def of(name: str) -> Column:
        return F.when(F.col("state") == IN, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    known = placed.select("path", "no", "block", "line", "text", of("s").alias("opens"), of("e").alias("leaves"), (F.col("before") + of("r")).alias("record"))
    alone = (F.col("opens") == OUT) & (F.col("leaves") == OUT)
    lines = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    joined = known.where(~alone).groupBy("path", "no", "record").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return known.where(alone & (F.col("text") != "")).select("path", "no", "record", "text").unionByName(joined)


def parsed(records: DataFrame, width: int, null_value: str = "") -> DataFrame:
    """The records without headers, and ``cells``, a struct _0, _1, ... of texts, as Spark's parser sees them; empty cells are null by default."""
    kinds = ", ".join(f"_{k} string" for k in range(width))
    cells = F.from_csv("text", kinds, {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": null_value})
    return records.where("record > 0").select("path", "no", "record", cells.alias("cells"))


def as_pattern(path: str) -> str:
    """A path of Spark's metadata as one that readers take: signs are themselves, and those of patterns escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(path))


def first_records(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, head) of all CSV files, found by tasks that read no further than a file's first record; Spark doesn't list empty files.

    A session of its own has each block read by a task of its own, in small batches, so a task can stop at once: blocks
    inside a file after a batch, those at its start behind the first record.
    """
    ship_package(spark)
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", "128m")
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, head, inside = None, [], True
        for batch in batches:
            for (path, block), lines in _runs(batch):
                if block != 0:
                    return
                lines[0] = lines[0] if head else lines[0].removeprefix(BOM)
                states = _states(lines, OUT if name is None else int(inside))
                closed = np.flatnonzero(states[1:] == OUT)
                name, inside = path, not len(closed)
                head += lines[: closed[0] + 1] if len(closed) else lines
            if not inside:
                break
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"\n".join(head)])], ["path", "head"])

    heads = written(read_lines(own, path, recursive).mapInArrow(first, "path string, head binary"), "heads")
    return spark.read.schema(heads.schema).parquet(heads.written_path)
