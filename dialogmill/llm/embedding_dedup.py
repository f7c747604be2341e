"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.llm.common import discard, group_arrow, map_arrow, settled, table
from dialogmill.llm.components import components

TABLES, BITS = 4, 64
#: Rows of postings that one task looks at.
PART_ROWS = 250_000
#: Rows of one key above which it is cut into blocks of about so many.
KEY_ROWS = 2_048
#: Vectors of a sample whose mean counts half, and the square of a mean beyond which nearly all vectors are alike.
FEW, ALIKE = 100, 0.75
#: Pairs that are looked at together.
BLOCK = 2_000_000


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are first scaled by a power of two, so that no square runs over or under."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each two rows in double precision; the scaling is by powers of two and so changes no digit."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None]) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


@dataclass(frozen=True)
class Quantiser:
    """Centre and rotations of unit vectors; the signs of the result are the code.

    The centre makes the bits even. It is left out where the sample tells little of it, or where nearly all vectors point one way: seen from amidst them,
    near copies would point anywhere.
    A rotation gives a bit for each component at most, so short vectors are turned several times, each time from another start.
    """

    mean: np.ndarray
    turn: np.ndarray

    @classmethod
    def learn(cls, sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 5) -> Quantiser:
        """Main directions of the sample, then alternately the nearest signs and the rotation that fits them best."""
        unit = unit_vectors(sample)
        mean, width = unit.mean(axis=0) * len(unit) / (len(unit) + FEW), min(bits, unit.shape[1])
        if mean @ mean > ALIKE:
            mean = np.zeros(len(mean))
        _, axes = np.linalg.eigh(np.cov((unit - mean).T).reshape(unit.shape[1], -1)) if len(unit) > 1 else (None, np.eye(unit.shape[1]))
        main = axes[:, ::-1][:, :width]
        flat = (unit - mean) @ main
        turns = []
        for start in range(-(-bits // width)):
            turn = np.linalg.qr(np.random.default_rng(seed + start).normal(size=(width, width)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ vt).T
            turns.append(main @ turn)
        return cls(mean, np.concatenate(turns, axis=1)[:, :bits])

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (unit_vectors(vectors) - self.mean) @ self.turn >= 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()


def _part(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (codes >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vector in a batch."""
    sizes = column.value_lengths().to_numpy()
    values, bound = column.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[bound[rows][:, None] + np.arange(size)]


def postings(vectors: DataFrame, quantisers: dict[int, Quantiser], bits: int) -> DataFrame:
    """(key, id, code, flip): each code under each of its substrings and under each neighbour of it at distance 1; vectors of different lengths share no key."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantisers)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint64)
        for batch in batches:
            for rows, matrix in _by_length(batch.column(1)):
                codes, own = shared.value[matrix.shape[1]].codes(matrix), pa.array(np.repeat(rows, len(flips)))
                each = pa.array(np.repeat(codes.view(np.int64), len(flips)))
                for k in range(TABLES):
                    keys = (_part(codes, k, bits)[:, None] ^ flips) | np.uint64(k << 40 | matrix.shape[1] << 42)
                    flip = pa.array(np.tile(np.arange(-1, bits, dtype=np.int8), len(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(own), each, flip], ["key", "id", "code", "flip"])

    fields = [T.StructField("key", T.LongType()), vectors.schema["id"], T.StructField("code", T.LongType()), T.StructField("flip", T.ByteType())]
    return map_arrow(vectors.select("id", "vector"), post, T.StructType(fields))


def _run_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs with one key in a sorted array, in blocks."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    end = np.repeat(np.append(first[1:], len(keys)), np.diff(np.append(first, len(keys))))
    after = end - np.arange(len(keys)) - 1  # partners behind each place
    start = 0
    total = np.cumsum(after)
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK, "right")))
        n = after[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def spread(posted: DataFrame, parts: int) -> DataFrame:
    """Postings with (part, i, j), the task that each goes to, and its block there.

    Keys of up to ``KEY_ROWS`` rows share ``parts`` tasks. Larger ones are cut into blocks by hash, and each two blocks i <= j
    of a key are a task, so a key with a large share of all rows is worked on by all executors.
    """
    key_part = F.pmod(F.xxhash64("key"), F.lit(parts))
    alone = lambda df: df.select("*", key_part.alias("part"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).cast("long").alias("block"))
    hot = settled(posted.groupBy("key").count().where(F.col("count") > KEY_ROWS).select("key", F.ceil(F.col("count") / KEY_ROWS).alias("blocks")), "hot")
    if hot.isEmpty():
        return alone(posted)
    cut = posted.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("id", "code", "flip"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = cut.select(*posted.columns, F.col("key").alias("part"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    return alone(posted.join(hot, "key", "left_anti")).union(pairs)


def candidates(posted: DataFrame, bits: int, most_apart: int, parts: int) -> DataFrame:
    """(a, b) once each: codes with a substring at distance 2 or less that differ in at most ``most_apart`` bits.

    Both meet in every key that is near both; the pair is taken in the first such key only, which follows from the codes.
    Tasks give their pairs in batches and hold no more than one.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        across, block = group["i"][0] != group["j"][0], group["block"].to_numpy()
        key, flip = group["key"].to_numpy(), group["flip"].to_numpy()
        order = np.lexsort((flip, key))
        key, flip, block = key[order], flip[order], block[order]
        code = group["code"].to_numpy()[order].view(np.uint64)
        ids = group["id"].combine_chunks().take(pa.array(order))
        for a, b in _run_pairs(key):
            keep = (flip[a] != flip[b]) | (flip[a] < 0)  # equal substrings meet under themselves
            if across:  # pairs inside a block have a task of their own
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
            keep = np.bitwise_count(code[a] ^ code[b]) <= most_apart
            a, b = a[keep], b[keep]
            at = (key[a] >> 40) & 3
            own = np.ones(len(a), bool)
            for k in range(TABLES):
                x, y = _part(code[a], k, bits), _part(code[b], k, bits)
                apart = np.bitwise_count(x ^ y)
                own &= ~((k < at) & (apart <= 2))
                here = at == k
                low = (x ^ y) & (~(x ^ y) + np.uint64(1))  # lowest bit in which they differ
                first = np.where(apart == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
                own &= ~here | ((key[a].view(np.uint64) & np.uint64((1 << 40) - 1)) == first)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[own])), ids.take(pa.array(b[own]))], ["a", "b"])

    fields = [T.StructField(c, posted.schema["id"].dataType) for c in ("a", "b")]
    return group_arrow(spread(posted, parts), ["part", "i", "j"], meet, T.StructType(fields))


def _cosines(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, x, y) of vectors whose cosine, in double precision, is at least ``least``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column(3)
            for rows, x in _by_length(batch.column(2)):
                y = others.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(x.shape)
                cosine = cosines(x, y)
                yield batch.select([0, 1]).take(pa.array(rows)).append_column("cosine", pa.array(cosine)).filter(pa.array(cosine >= least))

    return map_arrow(pairs, judge, T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("cosine", T.DoubleType())]))


def _quantisers(distinct: DataFrame, sample_rows: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vector, learnt on at most ``sample_rows`` of that length, first by hash."""
    found = {}
    for size in sorted(r[0] for r in distinct.select(F.size("vector")).distinct().collect()):
        sample = distinct.where(F.size("vector") == size).orderBy("h1", "h2").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
        found[size] = Quantiser.learn(sample.flatten().to_numpy().astype(np.float64).reshape(len(sample), size))
    return found


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, sample_rows: int = 20_000, most_apart: int = 18) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links at a cosine of ``least`` or more.

    Vectors that are null, zero or hold null or non-finite numbers link with nothing; others are compared with those of their
    own length. Equal vectors are merged first and count each other as links. A null id takes part but names no component,
    and one whose component has no other id has null for it. Repeated rows count as vectors of their own. Different vectors under one
    id are vectors of their own. An empty table gives an empty table.

    For each length of vector a rotation is learnt on at most ``sample_rows`` vectors, first by hash. All vectors are indexed:
    64 bits in 4 tables; codes meet when one of their substrings differs in 2 bits or less, which all do that differ in 11
    or less; a cosine of 0.95 means about 6.5 of 64, so 99 in 100 such pairs meet at the very edge and more above it. Codes more than
    ``most_apart`` bits apart aren't compared: of 20,000 pairs at a cosine of 0.951, of 16 to 256 components, none was over 16.
    Candidates are then compared by their vectors, so no link is below ``least``.
    """
    x = F.col("vector")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce(whole & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = embeddings.select(F.col(id_col).alias("own_id"), F.col(vector_col).alias("vector"))
    keyed = rows.withColumn("hashes", F.when(fine, F.struct(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))))
    equal = keyed.where("hashes IS NOT NULL").groupBy("hashes.h1", "hashes.h2", "vector").agg(F.min("own_id").alias("own_id"), F.count(F.lit(1)).alias("n"))
    merged = equal.groupBy("h1", "h2").agg(F.min("own_id").alias("own_id"), F.sum("n").alias("n"), F.first("vector").alias("vector"))  # 0.0 and -0.0
    distinct = settled(merged.withColumn("id", F.monotonically_increasing_id()), "vectors")
    quantisers = _quantisers(distinct, sample_rows)
    bits = BITS // TABLES
    parts = max(1, -(-distinct.count() * TABLES * (bits + 1) // PART_ROWS))
    pairs = candidates(postings(distinct, quantisers, bits), bits, most_apart, parts)
    left, right = distinct.select(F.col("id").alias("a"), F.col("vector").alias("x")), distinct.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    links = settled(_cosines(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), least), "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = distinct.select(F.col("id").alias("b"), F.col("n").alias("w"))
    degrees = both.join(weights, "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("others"))
    grouped = distinct.drop("vector").join(degrees, "id", "left").join(components(links, "a", "b"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    leads = grouped.groupBy("group").agg(F.min("own_id").alias("component"))
    named = grouped.drop("component").join(leads, "group").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    groups = settled(named, "groups")
    discard(links, distinct)
    out = keyed.select("own_id", F.col("hashes.h1").alias("h1"), F.col("hashes.h2").alias("h2")).join(groups, ["h1", "h2"], "left")
    component = F.coalesce("component", "own_id")
    return out.select(
        F.col("own_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("own_id") == component, F.lit(False)).alias("kept"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
