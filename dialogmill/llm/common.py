"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.tables import discard, shared_dir, ship_package  # noqa: F401  (operators take them from here)
from dialogmill.tables import written as settled  # noqa: F401

#: The six ASCII white-space characters, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(df: DataFrame, by: list[str], function: Callable, schema: T.StructType | str) -> DataFrame:
    """``applyInArrow`` whose workers can import this package."""
    ship_package(df.sparkSession)
    return df.groupBy(*by).applyInArrow(function, schema)


def bit_filter(keys: DataFrame, n: int, most: int = 1 << 27) -> np.ndarray:
    """Bits of which each of the n uniform 64-bit keys sets two: 16 for each key, but not more than ``most``. Built block by block."""
    size = min(most, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    key = F.col(keys.columns[0])
    places = keys.select(F.explode(F.array(F.pmod(key, F.lit(size)), F.pmod(F.shiftright(key, 32), F.lit(size)))).alias("at"))

    def block(group: pa.Table) -> pa.Table:
        at = group["at"].to_numpy()
        bits = np.zeros(1 << 16, bool)
        bits[at & 0xFFFF] = True
        return pa.table({"block": pa.array([int(at[0]) >> 16], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    built = group_arrow(places.select(F.shiftright("at", 16).alias("b"), "at").distinct(), ["b"], block, "block long, bits binary").toArrow()
    out = np.zeros(size // 8, np.uint8)
    for number, bits in zip(built["block"].to_pylist(), built["bits"].to_pylist(), strict=True):
        out[number << 13 : (number + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of a filter's: no key of it is missed, few others pass."""
    low, high = keys % (8 * len(bits)), (keys >> 32) % (8 * len(bits))
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & (bits[high >> 3] >> (high & 7).astype(np.uint8)) & 1 == 1


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` where all characters are single bytes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that is never learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
