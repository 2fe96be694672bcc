"""US federal holidays and period ends, as expressions and as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The days of the calendar. Days on a date, then days on the nth weekday
# (0 = Monday) of a month; nth -1 is the last. Observed dates are not shifted.
DATED = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
FLOATING = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))
# End of fixed values.
_DAY_NAMES = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_MONTH_DAYS = {5: 31}


def is_federal_holiday(when: Column) -> Column:
    """Whether a date or timestamp falls on a holiday: month, day and weekday decide, no join."""
    month, day, weekday = F.month(when), F.dayofmonth(when), F.weekday(when)
    found = F.lit(False)
    for m, d in DATED:
        found = found | ((month == m) & (day == d))
    for m, wd, nth in FLOATING:
        first = _MONTH_DAYS[m] - 6 if nth == -1 else 7 * (nth - 1) + 1
        found = found | ((month == m) & (weekday == wd) & day.between(first, first + 6))
    return found


def federal_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per holiday: ``holiday_date``."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    dates = [F.make_date("y", F.lit(m), F.lit(d)) for m, d in DATED]
    for m, wd, nth in FLOATING:
        if nth == -1:
            dates.append(F.next_day(F.date_sub(F.last_day(F.make_date("y", F.lit(m), F.lit(1))), 7), _DAY_NAMES[wd]))
        else:
            start = F.date_sub(F.make_date("y", F.lit(m), F.lit(1)), 1)
            dates.append(F.date_add(F.next_day(start, _DAY_NAMES[wd]), 7 * (nth - 1)))
    return years.select(F.explode(F.array(*dates)).alias("holiday_date"))


def days_to_period_end(when: Column) -> Column:
    return F.datediff(F.last_day(when.cast("date")), when.cast("date"))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored; the clock time counts."""
    return F.timestamp_diff("DAY", earlier, later)
