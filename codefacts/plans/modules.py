"""Module graph and call edges from parsed rows."""

from __future__ import annotations

import operator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.storage import saved


def resolved_imports(specifiers: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """program, file, specifier, target: the best candidate that exists, if it is a file of the program."""
    each = specifiers.select("program", "file", "specifier", F.posexplode("candidates").alias("place", "target"))
    found = each.join(known.select("program", F.col("file").alias("target")), ["program", "target"])
    best = found.groupBy("program", "file", "specifier").agg(F.min_by("target", "place").alias("target"))
    return best.join(files.select("program", F.col("file").alias("target")), ["program", "target"], "left_semi").select("program", "file", "specifier", "target")


def module_graph(files: DataFrame, exports: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """consumers, exports added by star re-exports, and file dependencies. imports: with target."""
    deps = imports.select("program", F.col("file").alias("src"), F.col("target").alias("dst")).distinct()
    to = lambda df, name: df.select("program", F.col("target").alias("exporter"), name.alias("name"), F.col("file").alias("importer"))
    named = to(imports.where("kind in ('named', 'default')"), F.coalesce(F.col("name"), F.lit("default")))
    offered = exports.select("program", F.col("file").alias("target"), F.col("name").alias("offered")).distinct()
    spaces = to(imports.where("kind = 'namespace'").drop("name").join(offered, ["program", "target"]), F.col("offered"))
    stars = imports.where("kind = 'star'").select("program", "file", "target", "stmt_ord")
    passed = saved(star_exports(exports, stars), "stars")
    consumers = named.unionByName(spaces).unionByName(passed.where("name is not null").select("program", F.col("target").alias("exporter"), "name", F.col("file").alias("importer"))).distinct()
    more = passed.where("added").select("program", "file", "name", "display", "line", "span_start", "ord")
    return consumers, more, deps


def star_exports(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """One pass over `export *` statements in order of file and statement; later ones see what earlier ones added.

    Rows: program, file (the importer), target, name and place of a passed name, and whether it was added.
    Order decides, so the programs that have such statements are each worked on in one task; only
    these programs' export names go there.
    """
    out = "program string, file string, target string, name string, display string, line int, span_start int, ord int, added boolean"
    stars = saved(stars, "star_statements")
    if stars.isEmpty():
        return stars.sparkSession.createDataFrame([], out)
    touched = exports.join(stars.select("program").distinct(), "program", "left_semi").select("program", "file", "name", "display", "line", "span_start", "ord")

    def run(key: tuple, own: pa.Table, star: pa.Table) -> pa.Table:
        have: dict[str, list[dict]] = {}
        for e in sorted(own.to_pylist(), key=lambda e: (e["file"], e["ord"])):
            have.setdefault(e["file"], []).append(e)
        rows = []
        for s in sorted(star.to_pylist(), key=lambda s: (s["file"].split("/"), s["stmt_ord"])):
            mine = have.setdefault(s["file"], [])
            for e in [e for e in have.get(s["target"], []) if e["name"] != "default"]:
                new = e["name"] not in {m["name"] for m in mine}
                row = e | {"file": s["file"], "ord": len(mine)}
                if new:
                    mine.append(row)
                rows.append(row | {"target": s["target"], "added": new})
        names = [c.split(" ")[0] for c in out.split(", ")]
        types = [pa.string()] * 5 + [pa.int32()] * 3 + [pa.bool_()]
        return pa.table([pa.array([r[n] for r in rows], type=t) for n, t in zip(names, types)], names=names)

    return touched.groupBy("program").cogroup(stars.groupBy("program")).applyInArrow(run, out)


def calls_to_edges(calls: DataFrame, decls: DataFrame, exports: DataFrame, imports: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (program, src, dst, call_start) and calls (program, file, call_start, resolved).

    Callees in the same file are known; others are names in another file, followed through imports
    and re-exports until a declaration is met. All names are followed at once, a join for each hop.
    """
    key = ["program", "at_file", "name", "member"]
    outer = calls.drop("target").where("specifier is not null").join(targets, ["program", "file", "specifier"]).withColumnRenamed("target", "at_file")
    asked = outer.select(*key)
    # What a module offers: a local declaration, or a name of another module.
    local = exports.where("local is not null").select("program", F.col("file").alias("at_file"), "name", "local")
    passed = exports.where("from_specifier is not null").select("program", "file", "name", F.col("from_specifier").alias("specifier"), "from_name")
    passed = passed.join(targets, ["program", "file", "specifier"]).select("program", F.col("file").alias("at_file"), "name", F.col("target").alias("to_file"), F.col("from_name").alias("to_name"))
    own = decls.select("program", F.col("file").alias("at_file"), F.col("name").alias("local"), F.col("target").alias("start"), "members", "from_specifier", "from_name")
    declared = local.join(own, ["program", "at_file", "local"])
    again = declared.where("from_specifier is not null").select("program", F.col("at_file").alias("file"), "name", F.col("from_specifier").alias("specifier"), "from_name").join(targets, ["program", "file", "specifier"])
    again = again.select("program", F.col("file").alias("at_file"), "name", F.col("target").alias("to_file"), F.col("from_name").alias("to_name"))
    via = saved(passed.unionByName(again), "via")
    stars = imports.where("kind = 'star'").select("program", F.col("file").alias("at_file"), F.col("target").alias("to_file")).distinct()
    ends = saved(declared.where("from_specifier is null").select("program", "at_file", "name", "start", "members"), "ends")
    names = saved(exports.select("program", F.col("file").alias("at_file"), "name").distinct(), "names")
    pending = saved(asked.distinct().select("*", F.col("at_file").alias("to_file"), F.col("name").alias("to_name"), F.col("member").alias("to_member"), F.lit(0).alias("hop")), "pending")
    # Followed until nothing is new: chains of any length, and cycles end as each place is asked once.
    found, seen, hop = pending.select(*key, F.col("to_file").alias("f"), F.lit(None).cast("int").alias("start"), "hop").limit(0), pending.drop("hop"), 0
    while not pending.isEmpty():
        hop += 1
        # '*' with a member is that name of the module itself.
        here = pending.select(*key, "hop", F.when((F.col("to_name") == "*") & F.col("to_member").isNotNull(), F.col("to_member")).otherwise(F.col("to_name")).alias("n"), F.when(F.col("to_name") == "*", F.lit(None)).otherwise(F.col("to_member")).alias("m"), F.col("to_file").alias("f"))
        there = lambda df: df.withColumnsRenamed({"at_file": "f", "name": "n"})
        hit = here.join(there(ends), ["program", "f", "n"]).select(*key, "f", F.when(F.col("m").isNull(), F.col("start")).otherwise(F.expr("get(transform(filter(members, x -> x.name = m), x -> x.target), 0)")).alias("start"), "hop")
        found = found.unionByName(hit)
        step = here.join(there(via), ["program", "f", "n"]).select(*key, "to_file", "to_name", F.col("m").alias("to_member"))
        unnamed = here.where("n <> 'default'").join(there(names), ["program", "f", "n"], "left_anti")
        step = step.unionByName(unnamed.join(stars.withColumnRenamed("at_file", "f"), ["program", "f"]).select(*key, "to_file", F.col("n").alias("to_name"), F.col("m").alias("to_member")))
        step = step.distinct()
        own = [step[c].eqNullSafe(seen[c]) for c in step.columns]
        pending = saved(step.join(seen, reduce(operator.and_, own), "left_anti").withColumn("hop", F.lit(hop)), "pending")
        seen = seen.unionByName(pending.drop("hop"))
    targets_of = found.where("start is not null").groupBy(*key).agg(F.min_by(F.struct("f", "start"), F.struct("hop", "f", "start")).alias("x")).select(*key, F.col("x.f").alias("dst_file"), F.col("x.start").alias("dst_start"))
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}"))
    outer = outer.alias("o").join(targets_of.alias("t"), same("program") & same("at_file") & same("name") & same("member")).select("o.program", "o.file", "o.call_start", "o.ord", "o.enclosing", "t.dst_file", "t.dst_start")
    inner = calls.where("target is not null").select("program", "file", "call_start", "ord", "enclosing", F.col("file").alias("dst_file"), F.col("target").alias("dst_start"))
    hits = saved(inner.unionByName(outer), "hits")
    fn = lambda file, start: F.concat_ws(":", F.col(file), F.col(start).cast("string"))
    edges = hits.where("enclosing is not null").select("program", fn("file", "enclosing").alias("src"), fn("dst_file", "dst_start").alias("dst"), "call_start")
    resolved = calls.select("program", "file", "call_start", "ord").join(hits.select("program", "file", "ord", F.lit(True).alias("resolved")), ["program", "file", "ord"], "left")
    return edges, resolved.select("program", "file", "call_start", F.coalesce("resolved", F.lit(False)).alias("resolved"))
