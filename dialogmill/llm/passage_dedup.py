"""Substring dedup: digests of lines, paragraphs and content-chosen passages, grouped globally; the earliest occurrence stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialogmill.llm.common import bit_filter, discard, map_arrow, passes, settled, table
from dialogmill.llm.text_hash import mix, powers, shingle_hashes, span_hashes, text_chunks, word_spans

MIN_WORDS, GAP = 40, 11
#: Keys for which a filter is broadcast (4 bits each, so 32 MB at most); for more, texts are joined with the keys they need.
FILTER_KEYS = 1 << 26
#: Told apart from the words before a run, those behind it have this in their key.
BEHIND = 0x5555555555555555


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each ``width`` neighbours, from runs that double in length."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values, size = of(values[:-step], values[step:]), size + step
    return values


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some ``width`` neighbours (of all, if there are fewer), each of them on ties."""
    width = min(width, len(values))
    least = _sliding(values, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, values.dtype), least, np.zeros(width - 1, values.dtype)])
    return np.flatnonzero(_sliding(around, width, np.maximum) == values)


def _totals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two running totals of a chunk's word hashes, from whose differences any run's digest follows."""
    zero, scale = np.zeros(1, np.uint64), powers(len(words))
    return tuple(np.concatenate([zero, np.cumsum(w * scale, dtype=np.uint64)]) for w in (words, mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))))


def _digests(totals: tuple[np.ndarray, np.ndarray], first: np.ndarray, stop: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits (64 and 32) that follow from the words first..stop-1, their number and the kind of unit, wherever they stand."""
    back = powers(len(totals[0]), inverse=True)[first]
    salt = mix((stop - first).astype(np.uint64) * np.uint64(2) + np.uint64(kind))
    digest, check = (mix((t[stop] - t[first]) * back + salt) for t in totals)
    return digest.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _blocks(raw: np.ndarray, off: np.ndarray, begin: np.ndarray, least: int, least_text: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of a chunk's lines and paragraphs of ``least`` words or more, and of its whole texts of ``least_text``."""
    cuts = np.union1d(off, np.flatnonzero(raw == 10))
    words = np.searchsorted(begin, cuts)
    at, to = words[:-1], words[1:]
    full = to > at
    fresh = np.isin(cuts[:-1], off)  # first line of a text
    opens = full & (fresh | ~np.concatenate([[False], full[:-1]]))
    closes = full & np.concatenate([fresh[1:] | ~full[1:], [True]])[: len(full)]
    head, tail = np.flatnonzero(opens), np.flatnonzero(closes)
    first, stop = np.concatenate([at[full], at[head]]), np.concatenate([to[full], to[tail]])
    fit = stop - first >= least
    text = np.searchsorted(begin, off)
    some = text[1:] - text[:-1] >= least_text
    both = np.stack([np.concatenate([first[fit], text[:-1][some]]), np.concatenate([stop[fit], text[1:][some]])])
    first, stop = np.unique(both, axis=1)  # a line may be its paragraph and its text
    return first, stop


def _repeated(rows: np.ndarray, first: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether an earlier unit of the same text has the same digest."""
    order = np.lexsort((first, digests, rows))
    again = np.zeros(len(rows), bool)
    again[order[1:]] = (rows[order[1:]] == rows[order[:-1]]) & (digests[order[1:]] == digests[order[:-1]])
    return again


def _characters(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte of a chunk, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _schema(docs: DataFrame, id_col: str, fields: str) -> T.StructType:
    return T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(fields)])


def _run_starts(words: np.ndarray, bound: np.ndarray, min_words: int, gap: int) -> np.ndarray:
    """First words of the runs of a chunk's texts, chosen by content."""
    order, long = shingle_hashes(words, 3), np.flatnonzero(np.diff(bound) >= min_words)
    return np.concatenate([np.zeros(0, np.int64), *[bound[k] + _minima(order[bound[k] : bound[k + 1] - max(min_words, 3) + 1], gap) for k in long]])


def passages(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, gap: int = GAP, line_words: int | None = None, text_words: int | None = None) -> DataFrame:
    """(id, row, digest, check, start, stop, again, place) of all units: code point offsets, whether the text itself holds it before, and
    a run's first word (-1: a line, paragraph or whole text).

    Units are whole texts of at least ``text_words`` words, lines and blank-line-separated paragraphs of at least ``line_words``, and runs of
    ``min_words`` words that start at a least word hash among ``gap`` neighbours, so that each repeated run of
    min_words + gap - 1 words holds one that starts alike wherever it stands.
    """
    least, least_text = (min_words if n is None else max(1, n) for n in (line_words, text_words))
    names = ["id", "row", "digest", "check", "start", "stop", "again", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, off in text_chunks(batch.column(2)):
                begin, end = word_spans(raw, off)
                if not len(begin):
                    continue
                words, bound = span_hashes(raw, begin, end), np.searchsorted(begin, off)
                totals, runs = _totals(words), _run_starts(words, bound, min_words, gap)
                first, stop = _blocks(raw, off, begin, least, least_text)
                place = np.concatenate([runs - bound[np.searchsorted(bound, runs, "right") - 1], np.full(len(first), -1)])
                digests = [np.concatenate(d) for d in zip(_digests(totals, runs, runs + min_words, 0), _digests(totals, first, stop, 1), strict=True)]
                first, stop = np.concatenate([runs, first]), np.concatenate([runs + min_words, stop])
                rows, points = np.searchsorted(off, begin[first], "right") - 1, _characters(raw)
                base, which = points[off[rows]], pa.array(rows + row)
                spans = [(x - base).astype(np.int32) for x in (points[begin[first]], points[end[stop - 1] + 1])]
                columns = (*digests, *spans, _repeated(rows, first, digests[0]), place.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *map(pa.array, columns)], names)

    schema = _schema(docs, id_col, "row long, digest long, check int, start int, stop int, again boolean, place int")
    return map_arrow(docs.select(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(text_col)), cut, schema)


def _occurrence(row, place, side: int):
    """Key of a run's side in a text; of columns or of arrays."""
    if isinstance(row, np.ndarray):
        return row ^ (place << 32) ^ (place << 3) ^ side
    wide = place.cast("long")
    return row.bitwiseXOR(F.shiftleft(wide, 32)).bitwiseXOR(F.shiftleft(wide, 3)).bitwiseXOR(F.lit(side))


def _contexts(docs: DataFrame, id_col: str, text_col: str, min_words: int, gap: int, wanted: DataFrame, held: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(key, context, id, row, place, edge, ends): up to gap - 1 words before or behind each run whose key is ``wanted``; ``held``: (id, row, key) of all runs.

    ``context`` holds four hash bytes of each word, the nearest first; ``ends`` the offset up to which a cut goes that takes so many of
    them in; ``edge`` that of the run itself. With ``asked`` (key of ``_occurrence``), only of these. Few others may be among them.
    """
    names = ["key", "context", "id", "row", "place", "edge", "ends"]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"), F.array().cast("array<long>").alias("keys"))
    filters = []
    for own in (wanted, asked):
        n = own.count() if own is not None else 0
        filters.append(bit_filter(own, n, 1 << 28) if own is not None and n <= FILTER_KEYS else None)
    if filters[0] is None:
        needed = held.join(wanted, "key", "left_semi").groupBy("id", "row").agg(F.collect_set("key").alias("keys"))
        texts = texts.drop("keys").join(needed, ["id", "row"])
    shared, with_ends = docs.sparkSession.sparkContext.broadcast(filters), asked is not None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, (of_keys, of_asked) = np.arange(gap - 1), shared.value
        for batch in batches:
            for row, raw, off in text_chunks(batch.column(2)):
                begin, end = word_spans(raw, off)
                words, bound, points = span_hashes(raw, begin, end), np.searchsorted(begin, off), _characters(raw)
                if not len(words):
                    continue
                every = _run_starts(words, bound, min_words, gap)
                digest, _ = _digests(_totals(words), every, every + min_words, 0)
                texts_of = np.searchsorted(bound, every, "right") - 1
                hashes = batch.column(1).to_numpy()[texts_of + row]
                for side in (0, 1):
                    key = digest ^ np.int64(side * BEHIND)
                    fit = passes(of_keys, key) if of_keys is not None else np.isin(key, batch.column(3).slice(row, len(off) - 1).flatten().to_numpy())
                    if of_asked is not None:
                        fit &= passes(of_asked, _occurrence(hashes, every - bound[texts_of], side))
                    run, text = every[fit], texts_of[fit]
                    base = points[off[text]]
                    if side:
                        place = run[:, None] + min_words + near
                        inside, edge = place < bound[text + 1][:, None], points[end[run + min_words - 1] + 1]
                    else:
                        place = run[:, None] - 1 - near
                        inside, edge = place >= bound[text][:, None], points[begin[run]]
                    bounds = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
                    seen = place[inside]
                    context = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer((bounds * 4).tobytes()), pa.py_buffer(words[seen].astype("<u4").tobytes())])
                    which, ends = pa.array(text + row), None
                    if not with_ends:
                        ends, edges = pa.nulls(len(run), pa.list_(pa.int32())), pa.nulls(len(run), pa.int32())
                    else:
                        at = (points[end[seen] + 1] if side else points[begin[seen]]) - np.repeat(base, np.diff(bounds))
                        ends, edges = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))), pa.array((edge - base).astype(np.int32))
                    columns = [pa.array(key[fit]), context, batch.column(0).take(which), batch.column(1).take(which), pa.array((run - bound[text]).astype(np.int32)), edges, ends]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*T.StructType.fromDDL("key long, context binary"), *_schema(docs, id_col, "row long, place int, edge int, ends array<int>")])
    return map_arrow(texts, look, schema).where(F.octet_length("context") > 0)


def _true_ends(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, row, start, stop, kept_id): how far each run that is ``asked`` for goes on as an earlier occurrence of it does.

    Contexts of one run are counted once each; beginnings that several have, or one has several times, are grouped globally and learn who has them first.
    """
    rank = F.struct("id", "row", "place")
    begun = F.explode(F.sequence(F.lit(1), (F.octet_length("context") / 4).cast("int"))).alias("n")
    part = F.expr("xxhash64(key, substring(context, 1, 4 * n))").alias("part")
    distinct = settled(candidates.groupBy("key", "context").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("times")), "contexts")
    opens = F.expr("xxhash64(key, substring(context, 1, 4))")
    shared = distinct.groupBy(opens.alias("opening")).agg(F.sum("times").alias("all")).where("all > 1").select("opening")
    first = distinct.join(shared, opens == F.col("opening"), "left_semi").select("key", "context", "rank", begun).groupBy(part).agg(F.min("rank").alias("first"))
    questions = asked.join(shared, opens == F.col("opening"), "left_semi")
    known = questions.select("key", "context").distinct().select("key", "context", begun).select("key", "context", "n", part).join(first, "part")
    known = known.groupBy("key", "context").agg(F.collect_list(F.struct("n", "first")).alias("firsts"))
    earlier = F.filter("firsts", lambda f: (f["first"]["id"] < F.col("id")) | ((f["first"]["id"] == F.col("id")) & (f["first"]["row"] == F.col("row")) & (f["first"]["place"] < F.col("place"))))
    found = questions.join(known, ["key", "context"]).withColumn("most", F.array_max(F.transform(earlier, lambda f: F.struct(f["n"].alias("n"), f["first"]["id"].alias("kept")))))
    to = F.get("ends", F.col("most.n") - 1)
    return found.where("most IS NOT NULL").select("id", "row", F.least(to, "edge").alias("start"), F.greatest(to, "edge").alias("stop"), F.col("most.kept").alias("kept_id"))


def _with_kept(units: DataFrame, name: str) -> DataFrame:
    """Units whose digest repeats, with the least id that holds it. ``units`` are made twice, which takes less than to keep them all on disk meanwhile."""
    seen = units.groupBy("digest", "check").agg(F.min("id").alias("kept_id"), F.max("id").alias("last_id"), F.bool_or("again").alias("twice"))
    seen = settled(seen.where("kept_id < last_id OR twice").select("digest", "check", "kept_id"), "repeats")
    found = settled(units.join(seen, ["digest", "check"]), name)
    discard(seen)
    return found


def _islands(units: DataFrame) -> DataFrame:
    """Adds ``__span``, the number of the group of overlapping units that each is in."""
    line = Window.partitionBy("id", "row").orderBy("start", "stop", "kept_id")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = units.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return apart.withColumn("__span", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gap: int = GAP, line_words: int | None = None, text_words: int | None = None) -> DataFrame:
    """(id, row, start, stop, kept_id): passages that an earlier occurrence makes redundant, merged where they touch.

    Occurrences rank by id, then place; the first of each digest stays. Words are compared with A-Z as a-z and
    whatever white space. Found are: whole texts of ``text_words`` words or more, lines and paragraphs of ``line_words`` or more
    (both ``min_words`` if not given; 1 takes all), and every repeated run of min_words + gap - 1 (50) words, cut to its true ends. Offsets are
    code points of the text as it is; ``row`` is its hash, ``kept_id`` the least id that keeps a part. Null and empty texts
    repeat nothing. Rows with null ids are never cut. Rows with one id and one text count as one, and different texts under one id
    don't make each other redundant. An empty table gives an empty table.

    Digests are counted before they are shuffled; only the repeated ones are joined back. Ends are found in a second
    pass over the texts that hold the outermost runs: the words around these are compared in the same way.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    repeated = _with_kept(passages(docs, id_col, text_col, min_words, gap, line_words, text_words), "repeated")
    redundant = F.expr("id <> kept_id OR again")
    runs = _islands(repeated.where("place >= 0").where(redundant))
    island = Window.partitionBy("id", "row", "__span")
    near = {"__0": F.col("place") - F.min("place").over(island) < gap, "__1": F.max("place").over(island) - F.col("place") < gap}
    sides = F.array(*[F.when(F.col(n), F.struct(F.col("digest").bitwiseXOR(F.lit(k * BEHIND)).alias("key"), F.lit(k).alias("side"))) for k, n in enumerate(near)])
    ends = settled(runs.withColumns(near).select("id", "row", "place", F.inline(F.array_compact(sides))), "ends")
    occurrence = F.when(F.col("side") == 0, _occurrence(F.col("row"), F.col("place"), 0)).otherwise(_occurrence(F.col("row"), F.col("place"), 1))
    held = repeated.where("place >= 0").select("id", "row", F.explode(F.array("digest", F.col("digest").bitwiseXOR(F.lit(BEHIND)))).alias("key"))
    options = (docs, id_col, text_col, min_words, gap, settled(ends.select("key").distinct(), "wanted"), held)
    asked = settled(ends.select(occurrence.alias("key")).distinct(), "asked-keys")
    wider = _true_ends(_contexts(*options), settled(_contexts(*options, asked), "asked"))
    extra = repeated.where(redundant).select("id", "row", "start", "stop", "kept_id").union(wider).distinct()
    spans = _islands(extra).groupBy("id", "row", "__span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_id").alias("kept_id"))
    return spans.select(F.col("id").alias(id_col), "row", "start", "stop", "kept_id")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "cut", **options) -> DataFrame:
    """All rows and columns with the redundant passages cut out of ``text_col``; ``out`` holds their offsets in the text as it was.

    Options and cases are those of ``repeated_passages``: null ids and null or empty texts stay as they are, repeated rows are each cut
    alike, ``out`` (null where nothing is cut) replaces a column of that name, and an empty table gives an empty table.
    """
    spans = repeated_passages(docs, id_col, text_col, **options)
    lists = spans.groupBy(F.col(id_col).alias("__cut_id"), F.col("row").alias("__cut_row")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cut"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text, cut):
            if text is None or cut is None:
                return text
            edges = [0, *(x for c in cut for x in (c["start"], c["stop"])), len(text)]
            return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    joined = docs.join(lists, (F.col(id_col) == F.col("__cut_id")) & (F.xxhash64(F.col(text_col)) == F.col("__cut_row")), "left")
    names = [c for c in docs.columns if c != out]
    return joined.select(*[without(F.col(text_col), "__cut").alias(c) if c == text_col else F.col(c) for c in names], F.col("__cut").alias(out))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated whole texts of any length, and lines, paragraphs and passages from 40 words on."""
    found = repeated_passages(table(spark, sf_dir, "documents"), text_words=1)
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("stop").alias("stop_char"), F.col("kept_id").alias("kept_doc_id"))
