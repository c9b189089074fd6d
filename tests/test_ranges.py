"""Containment joins and compiler tables against loops over all pairs."""

import random

from codefacts.findings import numbered
from codefacts.operators import ranges
from codefacts.plans.compiler import CALL_EXPRESSION, compiler_edges


def test_tightest_and_first_against_all_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(3000)])) for i in range(300)] + [("c", 900, 5)]
    spans = []
    for i in range(200):
        start = rng.randrange(3000)
        spans.append((rng.choice("ab"), i, start, start + rng.choice([0, 1, 2, 3, 8, 100, 1000, 1 << 20])))
    p = spark.createDataFrame(points, "g string, p long, at long")
    r = spark.createDataFrame(spans, "g string, r long, start long, end long")
    inside = [(a, b) for a in points for b in spans if a[0] == b[0] and a[2] is not None and b[2] <= a[2] < b[3]]
    assert sorted((x.point.p, x.range.r) for x in ranges.containing(p, r, ["g"]).collect()) == sorted((a[1], b[1]) for a, b in inside)
    slow = {}
    for a, b in inside:
        slow[a[1]] = min(slow.get(a[1], (1 << 40, 0)), (b[3] - b[2], b[1]))
    assert {x.point.p: x.range.r for x in ranges.tightest(p, r, ["g"], ["r"]).collect()} == {k: v[1] for k, v in slow.items()}
    first = {}
    for a, b in inside:
        first[b[1]] = min(first.get(b[1], 1 << 40), a[1])
    assert {x.range.r: x.point.p for x in ranges.first_inside(r, p, ["g"], ["p"]).collect()} == first
    assert "NestedLoop" not in ranges.tightest(p, r, ["g"], ["r"])._jdf.queryExecution().executedPlan().toString()


def test_edges_from_compiler_tables(spark):
    text = "const s = 'é𝒳';\nfunction f() { g(h()); }\nfunction g(x) {}\n"
    byte = lambda part: len(text[: text.index(part)].encode())
    unit = lambda part: len(text[: text.index(part)].encode("utf-16-le")) // 2
    sources = spark.createDataFrame([("p", "/r/a.ts", text)], "program string, file string, source string")
    calls = spark.createDataFrame([("p", "/r/a.ts", byte("g(h"), byte("f()")), ("p", "/r/a.ts", byte("h()"), byte("f()")), ("p", "/r/a.ts", 0, None)], "program string, file string, call_start int, enclosing int")
    functions = spark.createDataFrame([("p", "/r/a.ts", byte("f()"), 0), ("p", "/r/a.ts", byte("g(x"), 1)], "program string, file string, span_start int, ord int")
    nodes = [(1, CALL_EXPRESSION, unit("g(h") - 1, unit("; }")), (2, CALL_EXPRESSION, unit("h()"), unit("h()") + 3), (3, 9, unit("h()"), unit("h()") + 1), (7, 9, unit("function g"), unit("function g") + 16)]
    nodes = spark.createDataFrame([("p", "\\r\\a.ts", *n) for n in nodes], "program string, file string, index int, kind int, pos int, end int")
    signatures = spark.createDataFrame([("p", "\\r\\a.ts", 1, "\\r\\a.ts", 7), ("p", "\\r\\a.ts", 2, None, None)], "program string, file string, index int, to_file string, to_index int")
    edges, counts = compiler_edges(sources, calls, functions, nodes, signatures)
    assert [tuple(r) for r in edges.collect()] == [("p", "/r/a.ts", byte("f()"), "/r/a.ts", byte("g(x"), byte("g(h"))]
    assert [tuple(r) for r in counts.collect()] == [("p", 3, 1)]


def test_numbered(spark):
    rows = numbered(spark.range(1000).repartition(7).orderBy("id")).collect()
    assert sorted((r.place, r.id) for r in rows) == [(i + 1, i) for i in range(1000)]
