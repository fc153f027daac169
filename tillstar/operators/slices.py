"""Optional region / year / segment filters over the flat sales view."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two "no filter" words; an empty text means the same.
ALL_REGIONS = "Todas"
ALL = "Todos"


@dataclass(frozen=True)
class Slice:
    region: str | None = None
    year: str | int | None = None
    segment: str | None = None

    @property
    def has_region(self) -> bool:
        return bool(self.region) and self.region != ALL_REGIONS

    @property
    def has_year(self) -> bool:
        return bool(self.year) and self.year != ALL

    @property
    def has_segment(self) -> bool:
        return bool(self.segment) and self.segment != ALL

    @property
    def columns(self) -> tuple[str, ...]:
        """View columns the active filters read."""
        wanted = (
            (self.has_region, "region"),
            (self.has_year, "order_date"),
            (self.has_segment, "segment"),
        )
        return tuple(name for active, name in wanted if active)

    def condition(self) -> Column:
        test = F.lit(True)
        if self.has_region:
            test = test & (F.col("region") == self.region)
        if self.has_year:
            # a date range, unlike year(order_date), reaches the file scan
            first = dt.date(int(self.year), 1, 1)
            test = test & F.col("order_date").between(F.lit(first), F.lit(first.replace(month=12, day=31)))
        if self.has_segment:
            test = test & (F.col("segment") == self.segment)
        return test

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition()) if self.columns else df

