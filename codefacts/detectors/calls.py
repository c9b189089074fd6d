"""Detectors on the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.detectors.modules import reachable_files
from codefacts.findings import findings, point
from codefacts.operators.graph import forest_paths, in_degree, reachable
from codefacts.operators.relational import first_match, for_all, path_order
from codefacts.storage import saved


def with_exported(facts) -> DataFrame:
    """functions with is_exported: flagged, or of an exported name of their file."""
    names = facts.exports.select("program", "file", "name", F.lit(True).alias("by_name")).distinct()
    return facts.functions.join(names, ["program", "file", "name"], "left").withColumn("is_exported", F.col("exported") | F.coalesce("by_name", F.lit(False))).drop("by_name")


def chains(facts, options) -> DataFrame:
    """program, path (functions): from a function outside to a leaf, each on the way called at one place only."""
    functions = with_exported(facts)
    once = in_degree(facts.edges, ["program"]).where("in_degree = 1").select("program", F.col("node").alias("fn"))
    eligible = functions.join(once, ["program", "fn"])
    if not options.include_exported:
        eligible = eligible.where("not is_exported")
    return saved(forest_paths(facts.edges, eligible.select("program", F.col("fn").alias("node")), ["program"]), "chains")


def single_use_chain(facts, options, paths: DataFrame | None = None) -> DataFrame:
    paths = chains(facts, options) if paths is None else paths
    about = with_exported(facts).select("program", F.col("fn").alias("node"), "name", "display", "line", "span_start", "is_exported")
    named = paths.select("program", "path", F.posexplode("path").alias("at", "node")).join(about, ["program", "node"])
    label = F.col("name") if options.include_exported else F.when((F.col("at") == 0) & F.col("is_exported"), F.concat("name", F.lit("   (exported, not in chain)"))).otherwise(F.col("name"))
    steps = F.array_sort(F.collect_list(F.struct("at", label.alias("label"), path_order("display").alias("folder"), "span_start")))
    rows = named.groupBy("program", "path").agg(steps.alias("steps"), *[F.max(F.when(F.col("at") == 1, F.col(c))).alias(c) for c in ("name", "display", "line", "span_start")])
    evidence = F.transform("steps", lambda s: F.struct(s["label"].alias("label"), F.lit(None).cast("string").alias("annotation"), (s["at"] == 1).alias("is_subject")))
    order = F.transform("steps", lambda s: F.struct(s["folder"].alias("folder"), s["span_start"].alias("span_start"), s["label"].alias("label")))
    return findings(rows, "SingleUseChain", evidence, order)


def suppressed(facts, paths: DataFrame) -> DataFrame:
    """program, fn: chain members, and heads that only forward to the first of them."""
    inside = paths.select("program", F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("fn"))
    heads = paths.select("program", F.get("path", F.lit(0)).alias("src"), F.get("path", F.lit(1)).alias("dst")).distinct()
    forwards = facts.functions.where("forward is not null").select("program", F.col("fn").alias("src"), F.col("forward.call_start").alias("call_start"))
    forwarding = heads.join(facts.edges, ["program", "src", "dst"]).join(forwards, ["program", "src", "call_start"], "left_semi")
    return inside.unionByName(forwarding.select("program", F.col("src").alias("fn"))).distinct()


def empty_wrapper(facts, options, paths: DataFrame | None = None) -> DataFrame:
    """Functions whose body is one resolved call, outside chains."""
    paths = chains(facts, options) if paths is None else paths
    forwards = facts.functions.where("forward is not null").select("*", F.col("forward.call_start").alias("call_start"))
    edges = facts.edges.withColumnRenamed("src", "fn")
    wrappers = first_match(forwards.join(suppressed(facts, paths), ["program", "fn"], "left_anti"), edges, ["program", "fn", "call_start"], F.col("dst"), ["dst"])
    targets = facts.functions.select("program", F.col("fn").alias("dst"), F.col("name").alias("target"))
    rows = wrappers.join(targets, ["program", "dst"])
    note = F.when(F.col("forward.return_only"), "return only")
    return findings(rows, "EmptyWrapper", F.array(point("name", True, note), point("target")), F.struct("target"))


def unreachable_functions(facts, options) -> DataFrame:
    """Functions of reachable production files that no root calls, directly or through others."""
    functions = with_exported(facts)
    files = facts.files.select("program", "file", "is_entry", "is_test")
    per_file = functions.groupBy("program", "file").agg(F.bool_or("is_exported").alias("any_exported"))
    roots = functions.join(files, ["program", "file"]).join(per_file, ["program", "file"])
    of_entry = F.col("is_entry") & (F.col("is_exported") | ~F.col("any_exported"))
    roots = roots.where(of_entry if options.production else of_entry | F.col("is_test"))
    seen = reachable(facts.edges, roots.select("program", F.col("fn").alias("node")), ["program"]).withColumnRenamed("node", "fn")
    production = functions.join(files.where("not is_test"), ["program", "file"], "left_semi")
    rows = production.join(reachable_files(facts, options), ["program", "file"], "left_semi").join(seen, ["program", "fn"], "left_anti")
    return findings(rows, "Unreachable", F.array(point("name", True)), F.struct("fn"))


def tramp_data(facts, options) -> DataFrame:
    """Parameters whose every use is an argument of a resolved call of this function; one finding for each callee."""
    only = facts.params.where("n_refs > 0 and n_refs = size(forward_calls)").select("program", "fn", F.col("name").alias("param"), "line", "span_start", "forward_calls")
    key = ["program", "fn", "param", "span_start"]
    uses = only.select(*key, F.posexplode("forward_calls").alias("place", "call_start"))
    edges = facts.edges.select("program", F.col("src").alias("fn"), "call_start", "dst")
    whole = for_all(uses, edges, key, ["program", "fn", "call_start"])
    targets = uses.join(edges, ["program", "fn", "call_start"]).groupBy(*key, "dst").agg(F.min("place").alias("place"))
    owner = facts.functions.select("program", "fn", "display", F.col("name").alias("caller"))
    callee = facts.functions.select("program", F.col("fn").alias("dst"), F.col("name").alias("target"))
    rows = targets.join(whole, key, "left_semi").join(only.drop("forward_calls"), key).join(owner, ["program", "fn"]).join(callee, ["program", "dst"])
    evidence = F.array(point("caller", True, F.concat(F.lit("passes "), F.col("param"))), point("target"))
    return findings(rows, "TrampData", evidence, F.struct("fn", "place", "dst"), subject="param")
