"""Joins and aggregates with a rule of their own: first match, for all, single group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_group(rows: DataFrame, key: Sequence[str], group: str, members: str | None = None) -> DataFrame:
    """The keys whose rows all lie in one group, with that group (and the sorted distinct members)."""
    more = [F.array_sort(F.collect_set(members)).alias(members)] if members else []
    found = rows.groupBy(*key).agg(F.min(group).alias(group), F.max(group).alias("_last"), F.count(F.lit(1)).alias("n_rows"), *more)
    return found.where(F.col(group) == F.col("_last")).drop("_last")


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Column, take: Sequence[str]) -> DataFrame:
    """Inner join that keeps, for each key, the right row that is first in order."""
    best = right.groupBy(*on).agg(F.min_by(F.struct(*take), order).alias("_best"))
    return left.join(best, list(on)).select(*[left[c] for c in left.columns], *[F.col(f"_best.{c}").alias(c) for c in take])


def for_all(items: DataFrame, right: DataFrame, key: Sequence[str], on: Sequence[str]) -> DataFrame:
    """The keys of items all of whose rows have a match on the right."""
    flagged = items.join(right.select(*on).distinct().withColumn("_match", F.lit(True)), list(on), "left")
    return flagged.groupBy(*key).agg(F.every(F.coalesce("_match", F.lit(False))).alias("_all")).where("_all").drop("_all")


def path_order(path: str | Column) -> Column:
    """Sort key of a path: its components, not its characters."""
    return F.split(path, "/")


def parent_dir(path: str | Column) -> Column:
    """The folder of a path; '' for one without folder."""
    return F.regexp_replace(path, "/?[^/]*$", "")
