"""The public surface: a program's report, findings, fact tables and call counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.detectors import detect
from codefacts.plans.facts import Facts, Options, facts, read_sources
from codefacts.report import render
from codefacts.sources.program import load


def program_facts(spark: SparkSession, path: str) -> Facts:
    """Fact tables of the program at a tsconfig file or its folder."""
    return facts(*read_sources(spark, load(path)))


def many_facts(spark: SparkSession, paths: list[str]) -> Facts:
    """Fact tables of several programs at once; every table's rows name their program's root."""
    read = [read_sources(spark, load(p)) for p in paths]
    sources, known = read[0]
    for more, also in read[1:]:
        sources, known = sources.unionByName(more), known.unionByName(also)
    return facts(sources, known)


def find(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """All findings of a program as a table, in their order."""
    return detect(program_facts(spark, path), options)


def analyze(spark: SparkSession, path: str, options: Options = Options(), colored: bool = False) -> str:
    """The report of a program; empty without findings. Findings stream to the driver partition by partition."""
    return render(find(spark, path, options).toLocalIterator(), colored)


def call_counts(own: Facts) -> DataFrame:
    """program, calls, resolved."""
    return own.calls.groupBy("program").agg(F.count(F.lit(1)).alias("calls"), F.count_if("resolved").alias("resolved"))
