"""Detectors on the module graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.findings import findings, point
from codefacts.operators.graph import reachable
from codefacts.operators.relational import parent_dir, single_group


def false_sharing(facts, options) -> DataFrame:
    """Exports whose importers, tests and neighbours included, all lie in one folder."""
    displays = facts.files.select("program", F.col("file").alias("importer"), F.col("display").alias("label"))
    uses = facts.consumers.join(displays, ["program", "importer"]).withColumn("folder", parent_dir("label"))
    one = single_group(uses, ["program", "exporter", "name"], "folder", "label")
    exports = facts.exports.join(facts.files.select("program", "file", F.col("display").alias("file_display")), ["program", "file"])
    rows = exports.withColumnsRenamed({"file": "exporter", "display": "shown"}).join(one, ["program", "exporter", "name"])
    first = F.transform("label", lambda x, i: F.struct(x.alias("label"), F.when(i == 0, "one consumer group").alias("annotation"), F.lit(False).alias("is_subject")))
    return findings(rows, "FalseSharing", F.concat(first, F.array(point("shown", True))), F.struct("name", "ord"), "file_display", "shown")


def reachable_files(facts, options) -> DataFrame:
    """program, file: what entry points, and tests unless production, import directly or through others."""
    root = F.col("is_entry") if options.production else F.col("is_entry") | F.col("is_test")
    roots = facts.files.where(root).select("program", F.col("file").alias("node"))
    return reachable(facts.file_deps, roots, ["program"]).withColumnRenamed("node", "file")


def unreachable_files(facts, options) -> DataFrame:
    rows = facts.files.where("not is_test").join(reachable_files(facts, options), ["program", "file"], "left_anti")
    rows = rows.withColumns({"line": F.lit(1), "span_start": F.lit(0)})
    return findings(rows, "Unreachable", F.array(point("display", True)), F.struct("display"), subject="display")


def unreaching_test(facts, options) -> DataFrame:
    """Tests that import a production module none of whose functions their own functions reach."""
    tests = facts.files.where("is_test").select("program", F.col("file").alias("test"), F.col("display").alias("test_display"))
    modules = facts.files.where("not is_test").select("program", F.col("file").alias("module"), "display")
    pairs = facts.file_deps.select("program", F.col("src").alias("test"), F.col("dst").alias("module")).join(tests, ["program", "test"]).join(modules, ["program", "module"])
    owners = facts.functions.select("program", "fn", "file")
    roots = owners.withColumnRenamed("file", "test").join(pairs.select("program", "test").distinct(), ["program", "test"], "left_semi")
    closure = reachable(facts.edges, roots.select("program", "test", F.col("fn").alias("node")), ["program"], ["test"])
    reached = closure.join(owners.withColumnRenamed("fn", "node"), ["program", "node"]).select("program", "test", F.col("file").alias("module")).distinct()
    missed = pairs.join(reached, ["program", "test", "module"], "left_anti")
    places = facts.import_locations.select("program", F.col("file").alias("test"), F.col("target").alias("module"), "line", "span_start")
    rows = missed.join(places, ["program", "test", "module"], "left").withColumns({"line": F.coalesce("line", F.lit(1)), "span_start": F.coalesce("span_start", F.lit(0))})
    return findings(rows, "UnreachingTest", F.array(point("test_display"), point("display", True)), F.struct("module"), "test_display", "display")
