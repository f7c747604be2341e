"""Standardisation and principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialogmill.tables import ship_package


def standardize(df: DataFrame, continuous: Sequence[str]) -> DataFrame:
    """Continuous columns less their mean, over their population deviation; constant ones become 0. All others stay."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in continuous], *[F.stddev_pop(c).alias(f"__s_{c}") for c in continuous])
    z = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in continuous}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*[f"__{k}_{c}" for k in "ms" for c in continuous])


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, value) for a <= b in order of ``columns``: sample covariances, all in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs])))


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df.withColumns({c: F.col(c).cast("double") for c in columns}))


def _prepared(batch: pa.RecordBatch, columns: Sequence[str], fill: np.ndarray) -> np.ndarray:
    """The rows as a matrix; ``fill`` holds what missing (first row) and infinite values (second row) of each column become."""
    x = np.empty((len(batch), len(columns)))
    for j, c in enumerate(columns):
        v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        if not np.isfinite(v).all():
            v = np.where(np.isnan(v), fill[0, j], np.where(np.isinf(v), fill[1, j], v))
            v = np.where(np.isfinite(v), v, 0.0)
        x[:, j] = v
    return x


def _moments(df: DataFrame, columns: Sequence[str], fill: np.ndarray, near: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums, sums of the products of each two columns), all less ``near``, added up in each task first."""
    d = len(columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), _prepared(batch, columns, fill) - near])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    found = df.select(*columns).mapInArrow(add_up, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    total = found["v"].to_numpy().reshape(d + 1, d + 1) if len(found) else np.zeros((d + 1, d + 1))
    return total[0, 0], total[0, 1:], total[1:, 1:]


def principal_components(
    df: DataFrame, columns: Sequence[str], k: int | None = None, keep: Sequence[str] | None = None, scaled: Sequence[str] = (), fills: dict[str, tuple[float | None, float | None]] | None = None,
    reach: float | None = None
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``keep``, by default all columns, and an array column ``pcs`` of centred scores, loadings [column, component], explained shares).

    The ``scaled`` columns are divided by their population deviation first, constant ones become 0; ``fills`` tells what missing and infinite values
    of a column become, 0 without.
    With ``reach`` rows get as many components as explain this share of the variance. Nothing is turned until the rows are read. The largest loading of each component is positive. Products of columns are added up in the tasks, from each
    column's fill or mean on, so nothing cancels out; only these come to the driver.
    """
    ship_package(df.sparkSession)
    k, fills = k or len(columns), fills or {}
    keep = list(df.columns if keep is None else keep)
    fill = np.array([[0.0 if v is None else v for v in fills.get(c, (None, None))] for c in columns]).T
    means = None if all(c in fills for c in columns) else df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    near = fill[0] if means is None else np.array([fills[c][0] or 0.0 if c in fills else means[c] or 0.0 for c in columns])
    n, sums, products = _moments(df, columns, fill, near)
    off = sums / max(n, 1)
    covariance = (products - n * np.outer(off, off)) / max(n - 1, 1)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0) * (n - 1) / max(n, 1))
    factor = np.array([(1 / s if s > 0 else 0.0) if c in scaled else 1.0 for c, s in zip(columns, deviation, strict=True)])
    values, vectors = np.linalg.eigh(covariance * np.outer(factor, factor))
    values, loadings = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    shares = values[:k] / max(values.sum(), 1e-300)
    if reach is None:
        used = k
    else:
        ratios = df.sparkSession.createDataFrame([(j + 1, float(r)) for j, r in enumerate(shares)], "component int, ratio double")
        used = components_for_variance(ratios, reach).first()["n_components"]
    mean, turn = near + off, (factor[:, None] * loadings)[:, :used]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = (_prepared(batch, columns, fill) - mean) @ turn
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), used).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "pcs"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("pcs", T.ArrayType(T.DoubleType()))])
    rows = df.select(*keep, *[c for c in columns if c not in keep])
    return rows.mapInArrow(project, schema), loadings, shares


def components_for_variance(ratios: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(n_components, reached) of a table (component, ratio): the least number that explains ``threshold``, else all."""
    running = F.sum("ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    summed = ratios.withColumn("reached", running)
    number = F.coalesce(F.min(F.when(F.col("reached") >= threshold, F.col("component"))), F.max("component"))
    return summed.agg(number.alias("n_components"), F.coalesce(F.min(F.when(F.col("reached") >= threshold, F.col("reached"))), F.max("reached")).alias("reached"))
