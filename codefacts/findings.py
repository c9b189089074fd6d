"""Findings: one table for all detectors, and its total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.operators.relational import path_order
from codefacts.storage import saved

SCHEMA = "program string, shape string, detector_ord int, file string, line int, span_start int, subject string, evidence array<struct<label: string, annotation: string, is_subject: boolean>>, intra_ord long"
COLUMNS = [c.strip().split(" ")[0] for c in ("program", "shape", "detector_ord", "file", "line", "span_start", "subject", "evidence", "intra_ord")]

#: The kinds of findings by their detectors' order, and their headings.
HEADINGS = {
    "FalseSharing": "FALSE SHARING",
    "SingleUseChain": "SINGLE-USE CHAIN",
    "EmptyWrapper": "EMPTY WRAPPER",
    "Unreachable": "UNREACHABLE",
    "NearDuplicate": "NEAR-DUPLICATE",
    "TrampData": "TRAMP DATA",
    "TypeClone": "TYPE CLONE",
    "UnreachingTest": "UNREACHING TEST",
}


def point(label: Column | str, subject: bool = False, annotation: Column | None = None) -> Column:
    """A node of an evidence path."""
    own = F.col(label) if isinstance(label, str) else label
    note = F.lit(None).cast("string") if annotation is None else annotation
    return F.struct(own.alias("label"), note.alias("annotation"), F.lit(subject).alias("is_subject"))


def findings(rows: DataFrame, shape: str, evidence: Column, order: Column, file: str = "display", subject: str = "name") -> DataFrame:
    """Rows with program, line and span_start as findings; order: of those at one place with one subject."""
    place = Window.partitionBy("program", "file", "span_start", "subject").orderBy("_order")
    out = rows.select("program", F.lit(shape).alias("shape"), F.lit(list(HEADINGS).index(shape)).alias("detector_ord"), F.col(file).alias("file"), F.col("line").cast("int").alias("line"), F.col("span_start").cast("int").alias("span_start"), F.col(subject).alias("subject"), evidence.cast("array<struct<label: string, annotation: string, is_subject: boolean>>").alias("evidence"), order.alias("_order"))
    return out.withColumn("intra_ord", F.row_number().over(place).cast("long")).select(*COLUMNS)


def ordered(found: DataFrame) -> DataFrame:
    """By program, file component by component, place and subject; ties in detector order."""
    return found.orderBy("program", path_order("file"), "span_start", "subject", "detector_ord", "intra_ord")


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with ``place``, from 1: their number in the order. Counts of partitions alone meet in one place."""
    mark = saved(rows.withColumn("mark", F.monotonically_increasing_id()), "sorted")
    part = F.call_function("shiftright", F.col("mark"), F.lit(33))
    counts = mark.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = mark.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.withColumn("place", F.col("before") + F.col("mark").bitwiseAND((1 << 33) - 1) + 1).drop("mark", "part", "before")
