"""Lists for people: optional filters, a search in some columns, one order of several, a page and the total."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Listing:
    """What a list shows; empty values ask nothing.

    equal: column to value; one_of: column to values; between: column to first and last, either may be None;
    search: a text that one of ``searched`` holds, whatever the case, its % and _ meaning themselves.
    """

    equal: dict[str, object] = field(default_factory=dict)
    one_of: dict[str, tuple] = field(default_factory=dict)
    between: dict[str, tuple[object, object]] = field(default_factory=dict)
    search: str = ""
    searched: tuple[str, ...] = ()
    page: int = 1
    size: int = 20

    def condition(self) -> Column:
        out = F.lit(True)
        for c, v in self.equal.items():
            out = out & (F.col(c) == F.lit(v))
        for c, vs in self.one_of.items():
            out = out & F.col(c).isin(*vs)
        for c, (first, last) in self.between.items():
            out = out & (F.lit(True) if first is None else F.col(c) >= F.lit(first)) & (F.lit(True) if last is None else F.col(c) <= F.lit(last))
        if self.search.strip():
            found = F.lit(False)
            for c in self.searched:
                found = found | F.coalesce(F.contains(F.lower(c), F.lit(self.search.strip().lower())), F.lit(False))
            out = out & found
        return F.coalesce(out, F.lit(False))


def listed(rows: DataFrame, listing: Listing, order: list[Column], keys: DataFrame | None = None) -> DataFrame:
    """The rows of a page with ``place`` (from 1 in the whole list) and ``total``; ``keys`` keeps rows that it has (by its one column).

    The order must be total.  Only the rows up to the page's end are ever brought together.
    """
    if listing.page < 1 or not 1 <= listing.size <= 1000:
        raise ValueError("pages count from 1 and have 1 to 1000 rows")
    found = rows.where(listing.condition())
    if keys is not None:
        found = found.join(keys, keys.columns[0], "left_semi")
    total = found.agg(F.count("*").alias("total"))
    first = found.orderBy(*order).limit(listing.page * listing.size)
    place = first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return place.where(F.col("place") > (listing.page - 1) * listing.size).crossJoin(F.broadcast(total))


def latest(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key by a total order, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col("place") <= most)


def days_filled(rows: DataFrame, ts: str, days: int, measures: dict[str, Column]) -> DataFrame:
    """day and the measures of each of the last ``days`` days up to the newest row's; days without rows have 0."""
    last = rows.agg(F.to_date(F.max(ts)).alias("last"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), "last")).alias("day"))
    seen = rows.groupBy(F.to_date(ts).alias("day")).agg(*(m.alias(k) for k, m in measures.items()))
    return calendar.join(seen, "day", "left").select("day", *(F.coalesce(k, F.lit(0)).alias(k) for k in measures))
