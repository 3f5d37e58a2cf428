"""Dates and regular month grids.

A grid is (``start`` date, ``step`` months); grid point *i* is ``start`` plus
``i * step`` months. ``start`` should be a first of month.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class MonthGrid:
    """Grid dates ``start, start + step, ... <= stop``."""

    start: date
    stop: date
    step: int = 3

    def _months(self, day: Column) -> Column:
        return (F.year(day) - self.start.year) * 12 + F.month(day) - self.start.month

    def floor_index(self, day: Column) -> Column:
        """Index of the last grid date on or before ``day``."""
        late = F.when(F.dayofmonth(day) < self.start.day, 1).otherwise(0)
        return F.floor((self._months(day) - late) / self.step).cast("int")

    def ceil_index(self, day: Column) -> Column:
        """Index of the first grid date on or after ``day``."""
        more = F.when(F.dayofmonth(day) > self.start.day, 1).otherwise(0)
        return F.ceil((self._months(day) + more) / self.step).cast("int")

    def point(self, index: Column) -> Column:
        return F.add_months(F.lit(self.start), index * self.step)

    @property
    def last_index(self) -> int:
        months = (self.stop.year - self.start.year) * 12 + self.stop.month - self.start.month
        return (months - (self.stop.day < self.start.day)) // self.step

    def points(self) -> Column:
        """All grid dates as one array column."""
        return F.sequence(F.lit(self.start), F.lit(self.stop), F.expr(f"interval {self.step} month"))


def days(start: date | Column, stop: date | Column) -> Column:
    """Array of all days from ``start`` to ``stop``."""
    as_col = lambda d: d if isinstance(d, Column) else F.lit(d)
    return F.sequence(as_col(start), as_col(stop), F.expr("interval 1 day"))


def quarter_start(year: Column, quarter: Column) -> Column:
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def period_deviation(day: Column, year: Column, quarter: Column) -> Column:
    """Days between a date and the start of the period it is filed under."""
    return F.datediff(day, quarter_start(year, quarter))


def within_deviation(day: Column, year: Column, quarter: Column, limit: int = 250) -> Column:
    """True when the deviation lies in the open range (-limit, limit)."""
    gap = period_deviation(day, year, quarter)
    return (gap > -limit) & (gap < limit)
