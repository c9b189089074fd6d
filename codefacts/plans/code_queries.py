"""The detectors over a small program given as fact rows, each beside SQL over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.detectors import DETECTORS, detect
from codefacts.plans.facts import Facts, Options

P = "/p/"
FILES = ["src/index.ts", "src/a.ts", "src/b/c.ts", "src/b/d.ts", "src/dead.ts", "tests/a.test.ts", "tests/b.test.ts"]
#: file, name, starts; a function's identity is its file and start.
NAMES = {
    "src/index.ts": ["main", "unused", "default"],
    "src/a.ts": ["run", "step", "inner", "leaf", "wrap", "helper", "twin"],
    "src/b/c.ts": ["target", "twinB", "twinC", "loopX", "loopY", "small"],
    "src/b/d.ts": ["pass", "sink", "twinD"],
    "src/dead.ts": ["lost"],
    "tests/a.test.ts": ["default", "check"],
    "tests/b.test.ts": ["default"],
}
STARTS = {(f, n): 40 * i + 9 for f, names in NAMES.items() for i, n in enumerate(names)}


def at(file: str, name: str) -> str:
    return f"{P}{file}:{STARTS[file, name]}"


#: caller, callee, start of the call.
CALLS = [
    (("src/index.ts", "main"), ("src/a.ts", "run"), 20),
    (("src/index.ts", "main"), ("src/a.ts", "wrap"), 21),
    (("src/a.ts", "run"), ("src/a.ts", "step"), 30),
    (("src/a.ts", "step"), ("src/a.ts", "inner"), 61),
    (("src/a.ts", "step"), ("src/a.ts", "leaf"), 66),
    (("src/a.ts", "inner"), ("src/a.ts", "helper"), 101),
    (("src/a.ts", "leaf"), ("src/a.ts", "helper"), 141),
    (("src/a.ts", "wrap"), ("src/b/c.ts", "target"), 181),
    (("src/a.ts", "wrap"), ("src/b/c.ts", "target"), 185),
    (("src/b/c.ts", "loopX"), ("src/b/c.ts", "loopY"), 141),
    (("src/b/c.ts", "loopY"), ("src/b/c.ts", "loopX"), 171),
    (("src/b/d.ts", "pass"), ("src/b/d.ts", "sink"), 22),
    (("src/b/d.ts", "pass"), ("src/b/c.ts", "target"), 26),
    (("tests/a.test.ts", "default"), ("tests/a.test.ts", "check"), 15),
    (("tests/a.test.ts", "check"), ("src/a.ts", "helper"), 55),
]
FORWARDS = {("src/a.ts", "wrap"): (181, True), ("src/a.ts", "leaf"): (141, False), ("src/index.ts", "main"): (20, False), ("src/b/c.ts", "small"): (999, True)}
EXPORTS = [("src/index.ts", "main"), ("src/a.ts", "run"), ("src/a.ts", "wrap"), ("src/b/c.ts", "target"), ("src/b/d.ts", "pass"), ("src/b/d.ts", "default")]
IMPORTS = [("src/index.ts", "src/a.ts", "run"), ("src/index.ts", "src/a.ts", "wrap"), ("tests/a.test.ts", "src/a.ts", "run"), ("src/a.ts", "src/b/c.ts", "target"), ("src/b/d.ts", "src/b/c.ts", "target"), ("tests/b.test.ts", "src/b/c.ts", "nothing"), ("tests/b.test.ts", "src/b/d.ts", "pass"), ("src/index.ts", "src/b/d.ts", "pass")]
KINDS = ["Variables", "Call", "Ref"] * 8


def tokens(n: int, changed: int) -> list[str]:
    return [f"t{i % 37}" if i != changed else "other" for i in range(n)]


SHAPES = {("src/a.ts", "twin"): tokens(80, -1), ("src/b/c.ts", "twinB"): tokens(80, -1), ("src/b/c.ts", "twinC"): tokens(80, 2), ("src/b/d.ts", "twinD"): tokens(80, 40), ("src/b/c.ts", "small"): tokens(49, -1)}
PARAMS = [("src/b/d.ts", "pass", "p", 12, 2, [22, 26]), ("src/b/d.ts", "pass", "q", 14, 2, [22]), ("src/a.ts", "wrap", "w", 172, 1, [999]), ("src/b/d.ts", "sink", "s", 52, 0, [])]
FIELDS = [("id", False, True, "string"), ("name", True, False, "string"), ("tags", False, False, "string[]")]
TYPES = [("src/a.ts", "User", 300, False, FIELDS), ("src/b/c.ts", "Account", 310, False, FIELDS[::-1]), ("src/b/c.ts", "User", 350, False, FIELDS), ("src/b/d.ts", "Child", 320, True, FIELDS), ("src/b/d.ts", "Short", 340, False, FIELDS[:2]), ("src/b/d.ts", "Loose", 360, False, [(n, True, r, t) for n, _, r, t in FIELDS])]


def rows() -> dict[str, tuple[str, list[tuple]]]:
    """DDL and rows of each fact table."""
    functions = [("p", at(f, n), P + f, f, n, i + 1, STARTS[f, n], f == "src/index.ts" and n == "default", i, FORWARDS.get((f, n))) for f, names in NAMES.items() for i, n in enumerate(names)]
    deps = sorted({(a, b) for a, b, _ in IMPORTS})
    return {
        "files": ("program string, file string, display string, is_test boolean, is_entry boolean", [("p", P + f, f, f.startswith("tests"), f == "src/index.ts") for f in FILES]),
        "exports": ("program string, file string, name string, display string, line int, span_start int, ord int", [("p", P + f, n, n, i + 1, STARTS.get((f, n), 5), i) for i, (f, n) in enumerate(EXPORTS)]),
        "consumers": ("program string, exporter string, name string, importer string", [("p", P + b, n, P + a) for a, b, n in IMPORTS]),
        "file_deps": ("program string, src string, dst string", [("p", P + a, P + b) for a, b in deps]),
        "import_locations": ("program string, file string, target string, line int, span_start int", [("p", P + a, P + b, i + 2, 10 * i) for i, (a, b) in enumerate(deps) if b != "src/b/d.ts"]),
        "functions": ("program string, fn string, file string, display string, name string, line int, span_start int, exported boolean, ord int, forward struct<call_start: int, return_only: boolean>", functions),
        "edges": ("program string, src string, dst string, call_start int", [("p", at(*a), at(*b), s) for a, b, s in CALLS]),
        "calls": ("program string, file string, call_start int, resolved boolean", [("p", P + a[0], s, True) for a, _, s in CALLS]),
        "params": ("program string, fn string, name string, line int, span_start int, n_refs int, forward_calls array<int>", [("p", at(f, n), q, 3, s, r, c) for f, n, q, s, r, c in PARAMS]),
        "shapes": ("program string, file string, display string, name string, line int, span_start int, ast_kinds array<string>, tokens array<string>", [("p", P + f, f, n, 7, STARTS[f, n], KINDS, t) for (f, n), t in SHAPES.items()]),
        "types": ("program string, file string, display string, name string, line int, span_start int, has_extends boolean, fields array<struct<name: string, optional: boolean, readonly: boolean, canonical_type: string>>", [("p", P + f, f, n, 8, s, x, fields) for f, n, s, x, fields in TYPES]),
    }


def inline(spark: SparkSession) -> Facts:
    return Facts(**{name: spark.createDataFrame(data, ddl) for name, (ddl, data) in rows().items()})


def flat(found: DataFrame) -> DataFrame:
    """Findings with their evidence as one string."""
    step = lambda n: F.concat(n["label"], F.when(n["is_subject"], F.lit("*")).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(" | "), n["annotation"]), F.lit("")))
    return found.select("shape", "file", F.col("line").cast("long"), F.col("span_start").cast("long"), "subject", F.array_join(F.transform("evidence", step), " > ").alias("evidence"))


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, tuple):
        return "row(" + ", ".join(map(literal, value)) + ")"
    return str(value)


def values(name: str) -> str:
    ddl, data = rows()[name]
    columns, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            columns.append("")
        else:
            columns[-1] += c
    return f"{name}({', '.join(c.split()[0] for c in columns)}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in data)})"


EXPORTED = "fx AS (SELECT f.*, f.exported OR EXISTS (SELECT 1 FROM exports e WHERE e.file = f.file AND e.name = f.name) AS is_exported FROM functions f)"
CHAIN = f"""{EXPORTED}, el AS (SELECT fn FROM fx WHERE NOT is_exported AND fn IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) = 1)),
walk AS (SELECT [src, dst] AS path, dst AS last FROM (SELECT DISTINCT src, dst FROM edges) WHERE dst IN (SELECT fn FROM el) AND src NOT IN (SELECT fn FROM el)
  UNION ALL SELECT list_append(path, e.dst), e.dst FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = walk.last WHERE e.dst IN (SELECT fn FROM el) AND NOT list_contains(path, e.dst)),
chains AS (SELECT path FROM walk WHERE len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = walk.last AND e.dst IN (SELECT fn FROM el))),
inside AS (SELECT unnest(path[2:]) AS fn FROM chains UNION SELECT e.src FROM chains JOIN edges e ON e.src = path[1] AND e.dst = path[2] JOIN functions f ON f.fn = e.src AND f.forward[1] = e.call_start)"""
LIVE_FILES = "live AS (SELECT file FROM files WHERE is_entry OR is_test UNION SELECT d.dst FROM live JOIN file_deps d ON d.src = live.file)"

#: Tables and statement of each detector. A chain of a null annotation is a label alone.
STATEMENTS: dict[str, tuple[str, str]] = {
    "false_sharing": (
        "files exports consumers",
        """u AS (SELECT c.exporter, c.name, min(regexp_replace(f.display, '/?[^/]*$', '')) AS a, max(regexp_replace(f.display, '/?[^/]*$', '')) AS b, list_sort(list(DISTINCT f.display)) AS l
  FROM consumers c JOIN files f ON f.file = c.importer GROUP BY 1, 2)
SELECT 'FalseSharing' AS shape, f.display AS file, e.line, e.span_start, e.display AS subject,
  l[1] || ' | one consumer group > ' || array_to_string(list_transform(l[2:], lambda x: x || ' > '), '') || e.display || '*' AS evidence
FROM exports e JOIN u ON u.exporter = e.file AND u.name = e.name JOIN files f ON f.file = e.file WHERE a = b""",
    ),
    "single_use_chain": (
        "functions exports edges",
        CHAIN
        + """, s AS (SELECT path, unnest(path) AS fn, generate_subscripts(path, 1) AS i FROM chains)
SELECT 'SingleUseChain' AS shape, max(display) FILTER (i = 2) AS file, max(line) FILTER (i = 2) AS line, max(span_start) FILTER (i = 2) AS span_start, max(name) FILTER (i = 2) AS subject,
  string_agg(name || CASE WHEN i = 1 AND is_exported THEN '   (exported, not in chain)' ELSE '' END || CASE WHEN i = 2 THEN '*' ELSE '' END, ' > ' ORDER BY i) AS evidence
FROM s JOIN fx ON fx.fn = s.fn GROUP BY path""",
    ),
    "empty_wrapper": (
        "functions exports edges",
        CHAIN
        + """ SELECT 'EmptyWrapper' AS shape, f.display AS file, f.line, f.span_start, f.name AS subject,
  f.name || '*' || CASE WHEN f.forward[2] THEN ' | return only' ELSE '' END || ' > ' || t.name AS evidence
FROM functions f JOIN (SELECT src, call_start, min(dst) AS dst FROM edges GROUP BY 1, 2) e ON e.src = f.fn AND e.call_start = f.forward[1] JOIN functions t ON t.fn = e.dst
WHERE f.fn NOT IN (SELECT fn FROM inside)""",
    ),
    "unreachable_files": (
        "files file_deps",
        LIVE_FILES
        + """ SELECT 'Unreachable' AS shape, display AS file, 1 AS line, 0 AS span_start, display AS subject, display || '*' AS evidence
FROM files WHERE NOT is_test AND file NOT IN (SELECT file FROM live)""",
    ),
    "unreachable_functions": (
        "files file_deps functions exports edges",
        EXPORTED
        + ", "
        + LIVE_FILES
        + """, r AS (SELECT x.fn FROM fx x JOIN files f ON f.file = x.file WHERE f.is_test OR f.is_entry AND (x.is_exported OR NOT EXISTS (SELECT 1 FROM fx y WHERE y.file = x.file AND y.is_exported))
  UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.fn)
SELECT 'Unreachable' AS shape, x.display AS file, x.line, x.span_start, x.name AS subject, x.name || '*' AS evidence
FROM fx x JOIN files f ON f.file = x.file WHERE NOT f.is_test AND x.file IN (SELECT file FROM live) AND x.fn NOT IN (SELECT fn FROM r)""",
    ),
    "near_duplicate": (
        "shapes",
        """c AS (SELECT *, row_number() OVER (ORDER BY string_split(display, '/'), span_start, name) AS place FROM shapes WHERE len(ast_kinds) >= 20),
w AS (SELECT place, x, count(*) AS n FROM (SELECT place, unnest(list_transform(range(1, len(tokens) - 48), lambda i: array_to_string(list_slice(tokens, i, i + 49), ' '))) AS x FROM c) GROUP BY 1, 2),
o AS (SELECT a.place AS i, b.place AS j, sum(least(a.n, b.n)) AS shared FROM w a JOIN w b ON a.x = b.x AND a.place < b.place GROUP BY 1, 2)
SELECT 'NearDuplicate' AS shape, a.display AS file, a.line, a.span_start, a.name AS subject, a.name || '* > ' || b.name AS evidence
FROM o JOIN c a ON a.place = i JOIN c b ON b.place = j WHERE a.name <> b.name AND a.ast_kinds = b.ast_kinds AND shared / greatest(len(a.tokens) - 49, len(b.tokens) - 49) >= 0.7""",
    ),
    "tramp_data": (
        "params functions edges",
        """u AS (SELECT fn, name, span_start, line, unnest(forward_calls) AS call_start FROM params WHERE n_refs > 0 AND n_refs = len(forward_calls)),
good AS (SELECT fn, name, span_start FROM u GROUP BY 1, 2, 3 HAVING bool_and(EXISTS (SELECT 1 FROM edges e WHERE e.src = u.fn AND e.call_start = u.call_start)))
SELECT DISTINCT 'TrampData' AS shape, f.display AS file, u.line, u.span_start, u.name AS subject, f.name || '* | passes ' || u.name || ' > ' || t.name AS evidence
FROM u JOIN good USING (fn, name, span_start) JOIN edges e ON e.src = u.fn AND e.call_start = u.call_start JOIN functions f ON f.fn = u.fn JOIN functions t ON t.fn = e.dst""",
    ),
    "type_clone": (
        "types",
        """c AS (SELECT *, list_sort(fields) AS fs, row_number() OVER (ORDER BY string_split(display, '/'), span_start, name) AS place FROM types WHERE NOT has_extends AND len(fields) >= 3)
SELECT 'TypeClone' AS shape, a.display AS file, a.line, a.span_start, a.name AS subject, a.name || '* > ' || b.name AS evidence
FROM c a JOIN c b ON a.fs = b.fs AND a.place < b.place WHERE a.name <> b.name OR a.file <> b.file""",
    ),
    "unreaching_test": (
        "files file_deps functions edges import_locations",
        """r AS (SELECT f.file AS test, x.fn FROM files f JOIN functions x ON x.file = f.file WHERE f.is_test UNION SELECT r.test, e.dst FROM r JOIN edges e ON e.src = r.fn)
SELECT 'UnreachingTest' AS shape, t.display AS file, coalesce(l.line, 1) AS line, coalesce(l.span_start, 0) AS span_start, m.display AS subject, t.display || ' > ' || m.display || '*' AS evidence
FROM file_deps d JOIN files t ON t.file = d.src AND t.is_test JOIN files m ON m.file = d.dst AND NOT m.is_test LEFT JOIN import_locations l ON l.file = d.src AND l.target = d.dst
WHERE NOT EXISTS (SELECT 1 FROM r JOIN functions x ON x.fn = r.fn WHERE r.test = d.src AND x.file = d.dst)""",
    ),
}


def statement(name: str) -> str:
    tables, body = STATEMENTS[name]
    joined = ", ".join(values(t) for t in tables.split())
    inner = f"WITH RECURSIVE {joined}, {body}" if not body.startswith("SELECT") else f"WITH {joined} {body}"
    return f"SELECT shape, file, CAST(line AS BIGINT) AS line, CAST(span_start AS BIGINT) AS span_start, subject, evidence FROM ({inner})"


def oracle_sql() -> dict[str, str]:
    out = {f"q_code_facts_{name}": statement(name) for name in STATEMENTS}
    return out | {"q_code_facts_all": " UNION ALL ".join(f"({s})" for s in out.values())}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    one = lambda detector: lambda spark, sf_dir: flat(detector(inline(spark), Options()))
    out = {f"q_code_facts_{name}": one(detector) for name, detector in DETECTORS.items()}
    return out | {"q_code_facts_all": lambda spark, sf_dir: flat(detect(inline(spark), Options()))}
