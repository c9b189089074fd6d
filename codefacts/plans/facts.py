"""Fact tables of programs.

Every table has the column ``program``, and all joins carry it or a file's path: many programs are
analysed at once, spread over the cluster by file. Source text is parsed once, by file, in Arrow
batches; the parsed rows are written down, and all tables are explosions of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from codefacts.plans.modules import calls_to_edges, module_graph, resolved_imports
from codefacts.sources.program import Program, display_path, is_test_file
from codefacts.sources.resolve import candidates, entry_points
from codefacts.storage import saved

FILES = "program string, file string, display string, is_test boolean, is_entry boolean, config string"
EXPORTS = "name string, display string, line int, span_start int, ord int, local string, from_specifier string, from_name string"
IMPORTS = "specifier string, kind string, name string, line int, span_start int, stmt_ord int, name_ord int"
FUNCTIONS = "name string, line int, span_start int, exported boolean, ord int, forward struct<call_start: int, return_only: boolean>"
CALLS = "call_start int, enclosing int, target int, specifier string, name string, member string, ord int"
PARAMS = "fn_start int, name string, span_start int, line int, n_refs int, forward_calls array<int>"
SHAPES = "name string, line int, span_start int, ast_kinds array<string>, tokens array<string>"
TYPES = "name string, line int, span_start int, has_extends boolean, fields array<struct<name: string, optional: boolean, readonly: boolean, canonical_type: string>>"
DECLS = "name string, target int, from_specifier string, from_name string, members array<struct<name: string, target: int>>"
SPECIFIERS = "specifier string, candidates array<string>"
TABLES = {"exports": EXPORTS, "imports": IMPORTS, "functions": FUNCTIONS, "calls": CALLS, "params": PARAMS, "shapes": SHAPES, "types": TYPES, "decls": DECLS, "specifiers": SPECIFIERS}


@dataclass(frozen=True)
class Options:
    """production: tests are no roots of reachability. include_exported: exported functions may be in chains."""

    production: bool = False
    include_exported: bool = False


@dataclass
class Facts:
    """What detectors read.

    files: program, file, display, is_test, is_entry; exports: program, file, name, display, line,
    span_start, ord; consumers: program, exporter, name, importer; file_deps: program, src, dst;
    import_locations: program, file, target, line, span_start; functions: program, fn, file, display,
    name, line, span_start, exported, forward; edges: program, src, dst, call_start (each call site a
    row); calls: program, resolved; params: program, fn, name, line, span_start, n_refs, forward_calls;
    shapes: program, file, display, name, line, span_start, ast_kinds, tokens; types: likewise, with
    has_extends and fields.
    """

    files: DataFrame
    exports: DataFrame
    consumers: DataFrame
    file_deps: DataFrame
    import_locations: DataFrame
    functions: DataFrame
    edges: DataFrame
    calls: DataFrame
    params: DataFrame
    shapes: DataFrame
    types: DataFrame
    #: Tables that several detectors need, by name; new facts made of these start without.
    shared: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is computed and written when it is first asked for."""
        if name not in self.shared:
            self.shared[name] = saved(make(), "shared")
        return self.shared[name]


def parsed(sources: DataFrame) -> DataFrame:
    """Each file with the rows of all its tables as arrays. sources: FILES and source."""
    out = f"{FILES}, " + ", ".join(f"{t} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in split_ddl(ddl))}>>" for t, ddl in TABLES.items())
    kept = [f.name for f in _parse_datatype_string(FILES)]
    schema = to_arrow_schema(StructType(_parse_datatype_string(out).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codefacts.frontend.facts import File

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                f = File(row["source"] or "", row["file"])
                own = {k: row[k] for k in kept} | {t: getattr(f, t) for t in TABLES if t not in ("decls", "specifiers")}
                own["decls"] = list(f.decls.values())
                names = {i["specifier"] for i in f.imports} | {d["from_specifier"] for d in own["decls"] if d["from_specifier"]} | {e["from_specifier"] for e in f.exports if e["from_specifier"]}
                own["specifiers"] = [{"specifier": s, "candidates": candidates(row["file"], s, row["config"])} for s in sorted(names)]
                rows.append(own)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.mapInArrow(run, out)


def split_ddl(ddl: str) -> list[str]:
    """The columns of a DDL string, cut at its outer commas."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [o.strip() for o in out]


def exploded(rows: DataFrame, table: str) -> DataFrame:
    return rows.select("program", "file", F.col("display").alias("file_display"), F.explode(table).alias("x")).select("program", "file", "file_display", "x.*")


def facts(sources: DataFrame, known: DataFrame | None = None) -> Facts:
    """Fact tables of sources (FILES and source). known: program, file of all files that specifiers may resolve to."""
    rows = saved(parsed(sources.repartition("file")), "parsed")
    files = rows.select("program", "file", "display", "is_test", "is_entry")
    known = files.select("program", "file") if known is None else known.select("program", "file").distinct()
    targets = saved(resolved_imports(exploded(rows, "specifiers"), known, files), "resolved")
    exports = exploded(rows, "exports").drop("file_display")
    imports = exploded(rows, "imports").drop("file_display").join(targets, ["program", "file", "specifier"])
    consumers, more, deps = module_graph(files, exports, imports)
    decls = exploded(rows, "decls").drop("file_display")
    calls = exploded(rows, "calls").drop("file_display")
    functions = exploded(rows, "functions").withColumn("fn", fn("file", "span_start")).withColumnRenamed("file_display", "display")
    edges, resolved = calls_to_edges(calls, decls, exports, imports, targets)
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    # A dependency is placed at the first statement that resolves to it, else at the first that looks alike.
    at = exploded(rows, "imports").where("name_ord = 0").select("program", "file", "specifier", "line", "span_start", "stmt_ord")
    direct = at.join(targets, ["program", "file", "specifier"]).select("program", "file", "target", "line", "span_start", "stmt_ord")
    trimmed = F.regexp_replace("specifier", r"^\.*/*", "")
    tests = files.where("is_test").select("program", "file")
    alike = at.join(tests, ["program", "file"], "left_semi").join(deps.select("program", F.col("src").alias("file"), F.col("dst").alias("target")), ["program", "file"])
    alike = alike.where(F.col("target").endswith(trimmed) | (stem(F.col("target")) == stem(F.col("specifier")))).select(*direct.columns)
    located = direct.unionByName(alike).groupBy("program", "file", "target").agg(F.min_by(F.struct("line", "span_start"), "stmt_ord").alias("x")).select("program", "file", "target", "x.*")
    return Facts(
        files=files,
        exports=saved(exports.drop("local", "from_specifier", "from_name").unionByName(more), "exports"),
        consumers=saved(consumers, "consumers"),
        file_deps=saved(deps, "file_deps"),
        import_locations=located,
        functions=functions,
        edges=saved(edges, "edges"),
        calls=resolved,
        params=exploded(rows, "params").withColumn("fn", fn("file", "fn_start")),
        shapes=exploded(rows, "shapes").withColumnRenamed("file_display", "display"),
        types=exploded(rows, "types").withColumnRenamed("file_display", "display"),
    )


def fn(file: str, start: str):
    """A function's identity: its file and where it starts."""
    return F.concat_ws(":", F.col(file), F.col(start).cast("string"))


def with_edges(own: Facts, edges: DataFrame) -> Facts:
    """The same facts with call edges from elsewhere, such as a compiler.

    edges: program, src_file, src_span, dst_file, dst_span, call_start, a row for each call site;
    rows whose ends are no functions of the program are left out.
    """
    found = edges.select("program", fn("src_file", "src_span").alias("src"), fn("dst_file", "dst_span").alias("dst"), "call_start")
    for end in ("src", "dst"):
        found = found.join(own.functions.select("program", F.col("fn").alias(end)), ["program", end], "left_semi")
    return replace(own, edges=found.select("program", "src", "dst", "call_start"))


def read_sources(spark: SparkSession, program: Program) -> tuple[DataFrame, DataFrame]:
    """sources and known of one program; contents are read by Spark."""
    entries = entry_points(program)
    names = [(program.root, f, display_path(program.root, f), is_test_file(program.root, f), f in entries, program.config) for f in program.files]
    listed = spark.createDataFrame(names, FILES)
    known = spark.createDataFrame([(program.root, f) for f in program.known], "program string, file string")
    if not program.files:
        return listed.withColumn("source", F.lit("")), known
    texts = spark.read.format("binaryFile").load([f.replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for f in program.files])
    texts = texts.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.decode("content", "UTF-8").alias("source"))
    return listed.join(texts, "file").select(*listed.columns, "source"), known
