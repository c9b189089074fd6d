"""Containment joins: points in half-open ranges, as equi joins.

A range of a length up to 2^k lies in at most two cells of that size, so it makes two rows at most, at level k. A
point makes one row for each level that its group has ranges of. Both meet on group, level and cell; no pair of rows
that do not share a cell is looked at, however long or nested the ranges are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, ranges: DataFrame, by: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """by, point and range (structs of all columns): every pair with start <= at < end.

    Places are whole numbers of 0 and more. Null places and empty ranges meet nothing.
    """
    keys = list(by)
    size = F.col(end).cast("long") - F.col(start).cast("long")
    level = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    of_range = ranges.where(size > 0).select(*keys, F.struct("*").alias("range"), level.alias("level"), F.col(start).cast("long").alias("from"), F.col(end).cast("long").alias("to"))
    cell = lambda place: F.call_function("shiftright", place, F.col("level"))
    cells = of_range.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("from")), cell(F.col("to") - 1)))))
    levels = of_range.groupBy(*keys).agg(F.collect_set("level").alias("levels"))  # 63 at most
    placed = points.where(F.col(at).isNotNull()).select(*keys, F.struct("*").alias("point"), F.col(at).cast("long").alias("place"))
    placed = placed.join(levels, keys).select(*keys, "point", "place", F.explode("levels").alias("level")).withColumn("cell", cell(F.col("place")))
    return placed.join(cells, [*keys, "level", "cell"]).where("from <= place and place < to").select(*keys, "point", "range")


def tightest(points: DataFrame, ranges: DataFrame, by: Sequence[str], tie: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """by, point, range: of the ranges around each point the shortest, ties by ``tie``. Equal points answer once."""
    size = F.col(f"range.{end}").cast("long") - F.col(f"range.{start}").cast("long")
    found = containing(points, ranges, by, at, start, end)
    return found.groupBy(*by, "point").agg(F.min_by("range", F.struct(size.alias("size"), *[F.col(f"range.{c}").alias(f"t{i}") for i, c in enumerate(tie)])).alias("range"))


def first_inside(ranges: DataFrame, points: DataFrame, by: Sequence[str], order: Sequence[str | Column], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """by, range, point: of the points in each range the first in the order given by columns of the point. Equal ranges answer once."""
    found = containing(points, ranges, by, at, start, end)
    return found.groupBy(*by, "range").agg(F.min_by("point", F.struct(*[F.col(f"point.{c}") if isinstance(c, str) else c for c in order])).alias("point"))
