"""Time arithmetic on integers, so that ties and boundaries follow exact rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: Weeks are counted from this Monday.
ANCHOR_DATE = "2025-02-17"


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (or with the session's)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def whole_days(start: Column, end: Column) -> Column:
    return F.floor((micros(end) - micros(start)) / DAY)


def total_weeks(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(whole_days(start, end) / 7) + 1).cast("int")


def teaching_week(time: Column, start: Column, end: Column) -> Column:
    """Week of the course from 1 on; -1 outside its window or without one."""
    inside = (time >= start) & (time <= end)
    return F.when(inside, F.greatest(F.lit(1), F.floor(whole_days(start, time) / 7) + 1)).otherwise(-1).cast("int")


def calendar_week(time: Column, anchor: str = ANCHOR_DATE) -> Column:
    """Week since the anchor's, which is 1; the week before is 0."""
    return (F.floor(F.datediff(time.cast("date"), F.lit(anchor).cast("date")) / 7) + 1).cast("int")


def day_period(time: Column) -> Column:
    return F.hour(time) + F.minute(time) / 60.0


def is_weekend(time: Column) -> Column:
    return (F.weekday(time) >= 5).cast("int")


def parse_mixed_date(text: Column) -> Column:
    """Date of "2025年2月17..." or of an ISO date or time; else null."""
    trimmed = F.trim(text)
    part = [F.regexp_extract(trimmed, r"^(\d{4})年\s*0?(\d{1,2})月\s*0?(\d{1,2})", k) for k in (1, 2, 3)]
    chinese = F.to_date(F.try_to_timestamp(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), F.lit("yyyy-MM-dd")))
    return F.when(part[0] != "", chinese).otherwise(F.to_date(F.try_to_timestamp(trimmed)))


def parse_semester(text: Column) -> Column:
    """Struct (term_start, term_end, weeks) of "2025年2月17日至6月22日，18周"; nulls unless all of it can be read.

    An end without a year takes that of the start.
    """
    pattern = r"^(\d{4})年(\d{1,2})月(\d{1,2})日至(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日，\s*(\d+)\s*周"
    part = [F.regexp_extract(text, pattern, k) for k in range(8)]

    def date(year: Column, month: Column, day: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))

    start = date(part[1], part[2], part[3])
    end = date(F.when(part[4] == "", part[1]).otherwise(part[4]), part[5], part[6])
    fine = (part[0] != "") & start.isNotNull() & end.isNotNull()
    return F.struct(F.when(fine, start).alias("term_start"), F.when(fine, end).alias("term_end"), F.when(fine, part[7].try_cast("int")).alias("weeks"))
