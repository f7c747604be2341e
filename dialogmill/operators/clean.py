"""Cleaning of rows and of feature columns; statistics of columns in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.tables import discard, exact_percentiles, percentiles, written

#: Hours of a week: what stands for "none" among hours to classes.
DEFAULT_HOURS = 168.0
_INF = float("inf")


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == _INF, F.lit(False))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & ~is_infinite(x)


def clean_interactions(rows: DataFrame, text_columns: Sequence[str] = ("question",), time_text: str = "ask_time") -> DataFrame:
    """Line feeds in texts become spaces, times are parsed; rows without a student or a readable time go."""
    out = rows.withColumns({c: F.regexp_replace(c, "\n", " ") for c in text_columns})
    return out.withColumn(time_text, F.try_to_timestamp(F.col(time_text).cast("string"))).where(F.col(time_text).isNotNull() & F.col("student_id").isNotNull())


def replace_infinite(df: DataFrame, columns: Sequence[str], mode: str = "constant", multiplier: float = 1.5) -> DataFrame:
    """Infinite values become 168 ("constant") or ``multiplier`` times the greatest finite value, 168 without one ("max_multiple")."""
    if mode == "constant":
        return df.withColumns({c: F.when(is_infinite(F.col(c)), DEFAULT_HOURS).otherwise(F.col(c)) for c in columns})
    if mode != "max_multiple":
        raise ValueError(mode)
    tops = df.agg(*[F.max(F.when(is_finite(F.col(c)), F.col(c))).alias(f"__max_{c}") for c in columns])
    fill = {c: F.coalesce(F.col(f"__max_{c}") * multiplier, F.lit(DEFAULT_HOURS)) for c in columns}
    return df.join(F.broadcast(tops)).withColumns({c: F.when(is_infinite(F.col(c)), fill[c]).otherwise(F.col(c)) for c in columns}).drop(*[f"__max_{c}" for c in columns])


def impute_median(df: DataFrame, columns: Sequence[str], time_columns: Sequence[str] = ("hours_to_next_class", "hours_from_last_class"), accuracy: int | None = None) -> DataFrame:
    """Null and NaN become the column's median over finite values; so do infinite values, but in time columns 1.5 times the maximum.

    The median is exact, or approximate with an ``accuracy``. A column without a finite value keeps its nulls.
    """
    finite = {c: F.when(is_finite(F.col(c)), F.col(c)) for c in columns}
    tops = df.agg(*[F.max(v).alias(f"__max_{c}") for c, v in finite.items()])
    middles = percentiles(long_form(df.select(*[v.alias(c) for c, v in finite.items()]), columns), ["feature"], [0.5], accuracy=accuracy)
    row = middles.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"__mid_{c}") for c in columns])
    own = {c: F.coalesce(F.col(f"__max_{c}") * 1.5, F.lit(DEFAULT_HOURS)) if c in time_columns else F.col(f"__mid_{c}") for c in columns}
    filled = {c: F.when(is_infinite(F.col(c)), own[c]).when(is_finite(F.col(c)), F.col(c)).otherwise(F.col(f"__mid_{c}")) for c in columns}
    one_row = tops.join(F.broadcast(row))  # both hold one row
    return df.join(F.broadcast(one_row)).withColumns(filled).drop(*[f"__{k}_{c}" for k in ("mid", "max") for c in columns])


def median_fills(df: DataFrame, columns: Sequence[str], time_columns: Sequence[str] = ("hours_to_next_class", "hours_from_last_class")) -> dict[str, tuple[float | None, float | None]]:
    """What missing and infinite values of each column become by ``impute_median``, as numbers; a column without a finite value has no median."""
    finite = df.select(*[F.when(is_finite(F.col(c)), F.col(c)).alias(c) for c in columns])
    found = {r["feature"]: r["q"] for r in percentiles(long_form(finite, columns), ["feature"], [0.5, 1.0]).collect()}  # a row for each column
    return {c: _fills(*(found.get(c) or (None, None)), c in time_columns) for c in columns}


def logged_fills(df: DataFrame, columns: Sequence[str], replaced: Sequence[str], logged: Sequence[str], time_columns: Sequence[str] = ("hours_to_next_class", "hours_from_last_class"), multiplier: float = 1.5) -> tuple[dict[str, float], dict[str, tuple[float | None, float | None]]]:
    """(what ``replace_infinite`` by "max_multiple" makes of infinite values of the ``replaced`` columns, ``median_fills`` after it and ``log1p``) from one pass.

    Equal values of each column are counted once; greatest values and medians follow from these counts, so no changed rows are written.
    """
    value = F.col("value")
    counts = written(long_form(df, columns).where(value.isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "column-counts")
    finite = F.max(F.when(is_finite(value), value))
    tops = {r["feature"]: r["top"] for r in counts.groupBy("feature").agg(finite.alias("top")).collect()}  # a row for each column
    infinite = {c: DEFAULT_HOURS if tops.get(c) is None else tops[c] * multiplier for c in replaced}
    known = F.create_map(*[F.lit(x) for pair in infinite.items() for x in pair]) if infinite else F.create_map().cast("map<string,double>")
    filled = F.when(is_infinite(value), F.coalesce(known[F.col("feature")], value)).otherwise(value)
    final = F.when(F.col("feature").isin(*logged), F.log1p(filled)).otherwise(filled)
    rows = counts.select("feature", F.when(is_finite(final), final).alias("value"), "n")
    found = {r["feature"]: r["q"] for r in exact_percentiles(rows, ["feature"], [0.5, 1.0], weight="n").collect()}
    discard(counts)
    return infinite, {c: _fills(*(found.get(c) or (None, None)), c in time_columns) for c in columns}


def _fills(middle: float | None, top: float | None, is_time: bool) -> tuple[float | None, float | None]:
    return middle, middle if not is_time else DEFAULT_HOURS if top is None else 1.5 * top


def zero_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(is_finite(F.col(c)), F.col(c)).otherwise(0.0) for c in columns})


def log1p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns if c in df.columns})


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value): one row per column and row, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(pairs))


def column_quality(df: DataFrame, columns: Sequence[str], id_col: str | None = None, samples: int = 3) -> DataFrame:
    """Per column: infinite and missing values, and least, greatest, mean and deviation of the finite ones; with ``id_col`` the least ids that hold an infinite one."""
    finite = F.when(is_finite(F.col("value")), F.col("value"))
    keys = [F.col(id_col).alias("id")] if id_col else []
    rows = long_form(df.select(*keys, *columns), columns, ["id"] if id_col else [])
    stats = rows.groupBy("feature").agg(
        F.count(F.when(is_infinite(F.col("value")), 1)).alias("n_inf"), F.count(F.when(F.col("value").isNull() | F.isnan("value"), 1)).alias("n_missing"),
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"),
    )
    if not id_col:
        return stats
    place = F.row_number().over(Window.partitionBy("feature").orderBy("id"))
    some = rows.where(is_infinite(F.col("value"))).withColumn("__k", place).where(F.col("__k") <= samples).groupBy("feature").agg(F.sort_array(F.collect_list("id")).alias("sample_ids"))
    return stats.join(some, "feature", "left")


def feature_stats(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """min, max, mean, median and sample variance of each column."""
    v = F.col("value")
    rows = long_form(df, columns).where(v.isNotNull())
    stats = rows.groupBy("feature").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))
    middles = percentiles(rows, ["feature"], [0.5], accuracy=accuracy).select("feature", F.col("q")[0].alias("median"))
    return stats.join(middles, "feature").select("feature", "min", "max", "mean", "median", "variance")


def describe(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column."""
    v = F.col("value")
    rows = long_form(df, columns).where(v.isNotNull())
    stats = rows.groupBy("feature").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = stats.join(percentiles(rows, ["feature"], [0.25, 0.5, 0.75], accuracy=accuracy), "feature")
    return found.select("feature", "count", "mean", "std", "min", *[F.col("q")[k].alias(f"q{p}") for k, p in enumerate((25, 50, 75))], "max")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50, group: str | None = None, shared_range: bool = True) -> DataFrame:
    """(feature, [group,] bin, low, high, n): equal bins from least to greatest value, the last one closed; a constant has a range of 1 about it.

    With a ``group``, bins are counted in each; the range is the column's, or each group's own.
    """
    keys = [group] if group else []
    rows = long_form(df.select(*keys, *columns), columns, keys).where("value IS NOT NULL")
    per = ["feature", *([] if shared_range else keys)]
    limits = rows.groupBy(*per).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = F.col("lo") == F.col("hi")
    limits = limits.select(*per, F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = rows.join(limits, per).groupBy("feature", *keys, number.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("feature", *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def binary_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of 0 and 1 of the columns that hold nothing else; which these are is found first, so no other column's values are counted."""
    fits = df.agg(*[F.coalesce(F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)), F.lit(False)).alias(c) for c in columns]).first()
    binary = [c for c in columns if fits[c]]
    if not binary:
        return df.sparkSession.createDataFrame([], "feature string, value int, n long")
    rows = long_form(df, binary).where("value IS NOT NULL")
    return rows.groupBy("feature", F.col("value").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
