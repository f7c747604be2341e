"""Distances to class sessions and assignments: as-of lookups of each question in its class's calendar.

Questions and calendar entries form one frame, cut into (class, time bucket). A value comes from the running
extreme inside the bucket or is carried over from the buckets before (behind) it, which are summed up in a small table.
So a class with a third of all questions is spread over its buckets, and no row meets the whole calendar.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.functions.time import DAY, HOUR, micros
from dialogmill.tables import same, ship_package, written

#: The lookups: past values are greatest ones, future values least ones.
PAST = {"last_end": -1, "last_release": 0, "covered_until": 0}
FUTURE = ("next_start", "next_deadline")


def _entries(schedule: DataFrame, homework: DataFrame) -> DataFrame:
    """(class_id, us, one column per lookup): a row for each dated calendar entry."""

    def entry(source: DataFrame, time: str, **values: Column) -> DataFrame:
        us = micros(F.col(time))
        columns = [values.get(name, F.lit(None).cast("long")).alias(name) for name in (*PAST, *FUTURE)]
        return source.where(F.col(time).isNotNull()).select("class_id", us.alias("us"), *columns)

    start, end = micros(F.col("session_start")), micros(F.col("session_end"))
    return (
        entry(schedule, "session_start", next_start=start, covered_until=end)
        .union(entry(schedule, "session_end", last_end=end))
        .union(entry(homework, "release_time", last_release=micros(F.col("release_time"))))
        .union(entry(homework, "deadline_time", next_deadline=micros(F.col("deadline_time"))))
    )


def calendar_lookups(questions: DataFrame, schedule: DataFrame, homework: DataFrame, bucket_days: float = 7) -> DataFrame:
    """Adds last_end, last_release, covered_until, next_start and next_deadline (microseconds, null if none).

    last_end is before the question, last_release at it or before, next_start and next_deadline after it;
    covered_until is the latest end of a session that has started. Questions without a time stay, with nulls.
    """
    names = [*PAST, *FUTURE]
    nulls = [F.lit(None).cast("long").alias(n) for n in names]
    bucket = F.floor(F.col("us") / int(bucket_days * DAY)).alias("__bucket")
    asked = questions.select(F.struct(*questions.columns).alias("__row"), "class_id", micros(F.col("ask_time")).alias("us"), *nulls)
    entries = _entries(schedule, homework)
    noted = entries.select(F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), "class_id", "us", *names)
    both = asked.union(noted).select("*", bucket)
    inside = Window.partitionBy("class_id", "__bucket")
    up, down = inside.orderBy("us"), inside.orderBy(-F.col("us"))
    found = {n: F.max(n).over(up.rangeBetween(Window.unboundedPreceding, to)) for n, to in PAST.items()}
    found |= {n: F.min(n).over(down.rangeBetween(Window.unboundedPreceding, -1)) for n in FUTURE}
    looked = both.select("class_id", "__bucket", "__row", *[c.alias(n) for n, c in found.items()]).where(F.col("__row").isNotNull())
    # what is carried over follows from the calendars alone: a row for each bucket of a class's calendar and one at either side
    summed = entries.select("class_id", bucket, *names).groupBy("class_id", "__bucket").agg(*[F.max(n).alias(n) for n in PAST], *[F.min(n).alias(n) for n in FUTURE])
    by_bucket = written(summed, "buckets")  # read twice, and entries may be many
    ranges = by_bucket.groupBy(F.col("class_id").alias("__class")).agg((F.min("__bucket") - 1).alias("__lo"), (F.max("__bucket") + 1).alias("__hi"))
    every = ranges.select(F.col("__class").alias("class_id"), F.explode(F.sequence("__lo", "__hi")).alias("__bucket"))
    filled = same(every, by_bucket, ["class_id", "__bucket"], "left")
    behind = Window.partitionBy("class_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("class_id").orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    past, future = [F.max(n).over(behind).alias(f"__{n}") for n in PAST], [F.min(n).over(ahead).alias(f"__{n}") for n in FUTURE]
    carried = filled.select(F.col("class_id").alias("__class"), F.col("__bucket").alias("__near"), *past, *future)
    near = F.when(F.col("__bucket").isNotNull(), F.greatest("__lo", F.least("__hi", "__bucket")))
    placed = looked.join(ranges, F.col("class_id").eqNullSafe(F.col("__class")), "left").drop("__class").withColumn("__at", near)
    merged = placed.join(carried, F.col("class_id").eqNullSafe(F.col("__class")) & (F.col("__at") == F.col("__near")), "left")
    values = [F.greatest(n, f"__{n}").alias(n) for n in PAST] + [F.least(n, f"__{n}").alias(n) for n in FUTURE]
    return merged.select("__row.*", *values)


def _sorted_entries(entries: DataFrame) -> dict:
    """Of each class and lookup: times in order, and the value that holds from (past) or up to (future) each."""
    out: dict = defaultdict(dict)
    for class_id, every in entries.toArrow().to_pandas(integer_object_nulls=True).sort_values("us", kind="stable").groupby("class_id", dropna=False, sort=False):
        for name in (*PAST, *FUTURE):
            own = every[every[name].notna()]
            v = own[name].to_numpy().astype(np.int64)
            values = np.maximum.accumulate(v) if name in PAST else np.minimum.accumulate(v[::-1])[::-1]
            out[None if pd.isna(class_id) else class_id][name] = (own["us"].to_numpy(), values)
    return dict(out)


def calendar_search(questions: DataFrame, schedule: DataFrame, homework: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """The same as ``calendar_lookups`` by binary search in each class's sorted calendar, which every task is sent: questions aren't shuffled.

    Only the class and the time of a question go to Python. Calendars are counted first; those of more than ``max_bytes`` go through the windows.
    """
    spark, entries = questions.sparkSession, _entries(schedule, homework)
    if entries.count() * 16 * len((*PAST, *FUTURE)) > max_bytes:
        return calendar_lookups(questions, schedule, homework)
    ship_package(spark)
    names = [*PAST, *FUTURE]
    shared = spark.sparkContext.broadcast(_sorted_entries(entries))

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def search(class_id: pd.Series, us: pd.Series) -> pd.DataFrame:
        out = {n: np.zeros(len(us), np.int64) for n in names}
        known = {n: np.zeros(len(us), bool) for n in names}
        codes, classes = pd.factorize(class_id, use_na_sentinel=False)
        asked = us.notna().to_numpy()
        times = us.fillna(0).to_numpy().astype(np.int64)
        for code, own in enumerate(classes):
            rows = np.flatnonzero((codes == code) & asked)
            for n, (at, values) in shared.value.get(None if pd.isna(own) else own, {}).items():
                if n in PAST:
                    place = np.searchsorted(at, times[rows] + PAST[n], "right") - 1
                    fits = place >= 0
                else:
                    place = np.searchsorted(at, times[rows], "right")
                    fits = place < len(at)
                out[n][rows[fits]], known[n][rows[fits]] = values[place[fits]], True
        return pd.DataFrame({n: pd.arrays.IntegerArray(out[n], ~known[n]) for n in names})

    found = questions.withColumn("__found", search(F.col("class_id"), micros(F.col("ask_time"))))
    return found.select(*questions.columns, *[F.col(f"__found.{n}").alias(n) for n in names])


def with_distances(looked: DataFrame, none_hours: float = 168.0, max_hours: float = 720.0) -> DataFrame:
    """Hours to and from classes and assignments, and whether a session is on, from the lookups.

    Without a class the distance is ``none_hours``; those to assignments are at most ``max_hours``, also without any.
    """
    t = micros(F.col("ask_time"))
    hours = lambda us: us / float(HOUR)
    return looked.withColumns({
        "hours_to_next_class": F.coalesce(hours(F.col("next_start") - t), F.lit(none_hours)),
        "hours_from_last_class": F.coalesce(hours(t - F.col("last_end")), F.lit(none_hours)),
        "hours_to_assignment": F.least(F.coalesce(hours(F.col("next_deadline") - t), F.lit(max_hours)), F.lit(max_hours)),
        "hours_since_release": F.least(F.coalesce(hours(t - F.col("last_release")), F.lit(max_hours)), F.lit(max_hours)),
        "in_class_time": F.coalesce(F.col("covered_until") >= t, F.lit(False)).cast("int"),
    }).drop(*PAST, *FUTURE)
