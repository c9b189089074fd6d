"""Detectors on the shapes of functions and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.findings import findings, point
from codefacts.operators.relational import path_order
from codefacts.operators.similarity import equal_pairs, once, overlaps, profiles, windows
from codefacts.storage import saved

#: The least nodes of a body, the least share of common windows, the least fields of a type.
LEAST_NODES, LEAST_SHARE, LEAST_FIELDS = 20, 0.7, 3


def pair_findings(pairs: DataFrame, shape: str) -> DataFrame:
    """Pairs of structs a and b, of which a comes first, as findings at a."""
    rows = pairs.select(F.col("a.program").alias("program"), *[F.col(f"a.{c}").alias(c) for c in ("display", "name", "line", "span_start")], F.col("b.name").alias("other"), F.col("b.display").alias("other_display"), F.col("b.span_start").alias("other_start"))
    return findings(rows, shape, F.array(point("name", True), point("other")), F.struct(path_order("other_display"), "other_start", "other"))


def near_duplicate(facts, options) -> DataFrame:
    """Pairs of differently named functions with equal node kinds and enough common token windows.

    Functions with equal windows share a profile; overlaps are found between profiles, inside a
    program and shape, and only then are the pairs of their functions made, which are the findings.
    """
    big = facts.shapes.where(F.size("ast_kinds") >= LEAST_NODES)
    items = big.select("program", "display", "span_start", "name", "line", F.sha2(F.array_join("ast_kinds", " "), 256).alias("kinds"), once(windows("tokens")).alias("windows"))
    items = saved(items.where(F.size("windows") > 0).withColumn("windows", F.array_sort("windows")), "windows")
    groups = profiles(items, ["program", "display", "span_start", "name"], ["program", "kinds"])
    near = overlaps(groups, ["program", "kinds"], LEAST_SHARE).select("a", "b")
    same = groups.where("members > 1").select(F.col("profile").alias("a"), F.col("profile").alias("b"))
    of = items.join(groups.select("program", "kinds", "windows", "profile"), ["program", "kinds", "windows"])
    member = of.select("profile", F.struct("program", "display", "span_start", "name", "line").alias("item"), F.struct("program", path_order("display"), "span_start", "name").alias("at"))
    left = member.select(F.col("profile").alias("a"), F.col("item").alias("x"), F.col("at").alias("at_x"))
    right = member.select(F.col("profile").alias("b"), F.col("item").alias("y"), F.col("at").alias("at_y"))
    pairs = near.unionByName(same).join(left, "a").join(right, "b").where("x.program = y.program and x.name <> y.name and (a <> b or at_x < at_y)")
    turned = F.col("at_x") < F.col("at_y")
    return pair_findings(pairs.select(F.when(turned, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("b")), "NearDuplicate")


def type_clone(facts, options) -> DataFrame:
    """Pairs of types without heritage that have equal fields, unless of one name in one file."""
    items = facts.types.where(~F.col("has_extends") & (F.size("fields") >= LEAST_FIELDS))
    items = items.select("program", "file", "display", "name", "line", "span_start", F.array_sort("fields").alias("fields"))
    apart = (F.col("a.name") != F.col("b.name")) | (F.col("a.file") != F.col("b.file"))
    items = items.withColumn("folders", path_order("display"))
    return pair_findings(equal_pairs(items, ["folders", "span_start", "name"], ["program", "fields"], apart), "TypeClone")
