"""Call edges from what a compiler says: its nodes of each file and the declaration that each call resolves to.

A compiler numbers the nodes of a file, counts places in UTF-16 units and names a call by its node. Our calls and
functions are places in bytes. A call belongs to the tightest call node around its first byte, and a declaration's node to the
first function, in file order, that begins inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.operators.ranges import first_inside, tightest

#: Fixed value: the compiler's number for call expressions.
CALL_EXPRESSION = 214


def canonical(path: Column, case_sensitive: bool = True) -> Column:
    """One spelling of a path: slashes, and lower case where the file system does not tell case apart."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return out if case_sensitive else F.lower(out)


def utf16(source: Column, place: Column) -> Column:
    """A place in bytes as a place in UTF-16 units; one inside a character counts as the character's beginning."""
    before = F.decode(F.substring(F.encode(source, "UTF-8"), F.lit(1), place), "UTF-8")
    # A cut character decodes to signs of replacement, which the text itself would not have there.
    whole = F.when(F.startswith(source, before), before).otherwise(F.regexp_replace(before, "\\ufffd+$", ""))
    return (F.octet_length(F.encode(whole, "UTF-16LE")) / 2).cast("long")


def compiler_edges(sources: DataFrame, calls: DataFrame, functions: DataFrame, nodes: DataFrame, signatures: DataFrame, case_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """edges (program, src_file, src_span, dst_file, dst_span, call_start) for ``facts.with_edges``, and counts (program, calls, resolved).

    sources: program, file, source. calls: program, file, call_start, enclosing. functions: program, file, span_start, ord.
    nodes: program, file, index, kind, pos, end (in UTF-16 units). signatures: program, file, index (of a call's node), to_file, to_index
    (of the declaration's node); calls without a row, or with null there, are not resolved. Paths of nodes and signatures may have backslashes.
    """
    keys = ["program", "path"]
    spelled = lambda df, column, name: df.withColumn(name, canonical(F.col(column), case_sensitive))
    texts = spelled(sources.select("program", "file", "source"), "file", "path").select(*keys, "source")
    own = spelled(nodes, "file", "path").select(*keys, "index", "kind", F.col("pos").alias("start"), "end")
    placed = spelled(calls.select("program", "file", "call_start", "enclosing"), "file", "path").join(texts, keys).withColumn("at", utf16(F.col("source"), F.col("call_start"))).drop("source")
    # The compiler's call around each call, and the declaration it resolves to.
    called = tightest(placed, own.where(F.col("kind") == CALL_EXPRESSION), keys, ["index"]).select("program", "path", F.col("range.index").alias("index"), "point")
    to = spelled(spelled(signatures.where("to_index is not null"), "file", "path"), "to_file", "to_path").select(*keys, "index", "to_path", "to_index").distinct()
    hits = called.join(to, [*keys, "index"])
    # The first function that begins inside a declaration.
    begins = spelled(functions.select("program", "file", "span_start", "ord"), "file", "path").join(texts, keys).withColumn("at", utf16(F.col("source"), F.col("span_start"))).drop("source")
    asked = hits.select("program", F.col("to_path").alias("path"), F.col("to_index").alias("index")).distinct()
    declared = first_inside(own.join(asked, [*keys, "index"], "left_semi"), begins, keys, ["ord"])
    target = declared.select("program", F.col("path").alias("to_path"), F.col("range.index").alias("to_index"), F.col("point.file").alias("dst_file"), F.col("point.span_start").alias("dst_span"))
    found = hits.join(target, ["program", "to_path", "to_index"])
    edges = found.where("point.enclosing is not null").select("program", F.col("point.file").alias("src_file"), F.col("point.enclosing").alias("src_span"), "dst_file", "dst_span", F.col("point.call_start").alias("call_start"))
    total = calls.groupBy("program").agg(F.count(F.lit(1)).alias("calls"))
    resolved = found.groupBy("program").agg(F.count(F.lit(1)).alias("resolved"))
    return edges, total.join(resolved, "program", "left").select("program", "calls", F.coalesce("resolved", F.lit(0)).alias("resolved"))
