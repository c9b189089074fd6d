"""Generic operators and the queries over fact rows against SQL."""

import random
import re
import time
from collections import Counter

import duckdb
import pytest

from codefacts.operators import graph, relational, similarity
from codefacts.plans import code_queries


@pytest.mark.parametrize("name", sorted(set(code_queries.oracle_sql()) - {"q_code_facts_all"}))
def test_detector_against_sql(spark, name):
    found = code_queries.queries()[name](spark, "")
    rows = duckdb.connect().execute(code_queries.oracle_sql()[name]).df()
    assert sorted(rows.columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*rows.columns).collect())) == sorted(rows.itertuples(index=False, name=None))
    assert len(rows)


@pytest.fixture
def edges(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 4), (4, 5), (6, 7), (7, 8), (7, 8)] + [(100 + i, 101 + i) for i in range(60)]
    return spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, src long, dst long")


def test_reachable_in_tasks_and_in_rounds(spark, edges, monkeypatch):
    roots = spark.createDataFrame([("g", 1), ("g", 4), ("g", 155), ("h", 1)], "g string, node long")
    expected = {("g", n) for n in (1, 2, 3, 4, 5, *range(155, 161))}
    assert sorted(map(tuple, graph.reachable(edges, roots, ["g"]).collect())) == sorted(expected | {("h", 1)})
    monkeypatch.setattr(graph, "IN_TASK", 1)
    assert sorted(map(tuple, graph.reachable(edges, roots, ["g"]).collect())) == sorted(expected | {("h", 1)})
    assert graph.reachable(edges, roots.limit(0), ["g"]).count() == 0


def test_reachable_by_label(spark, edges):
    roots = spark.createDataFrame([("g", "a", 1), ("g", "b", 3), ("g", "b", 7)], "g string, l string, node long")
    assert sorted((r.l, r.node) for r in graph.reachable(edges, roots, ["g"], ["l"]).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 7), ("b", 8)]


def test_forest_paths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4), (9, 5), (6, 7), (7, 6), (0, 8)], "src long, dst long")
    eligible = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 6, 7, 8)], "node long")
    assert sorted(r.path for r in graph.forest_paths(edges, eligible).collect()) == [[0, 1, 2, 3], [0, 1, 2, 4]]


def test_in_degree_counts_call_sites(edges):
    assert {r.node: r.in_degree for r in graph.in_degree(edges).collect()}[8] == 2


def test_windows_and_overlaps(spark):
    rows = [(1, list("abcdefgh")), (2, list("abcdefgh")), (3, list("abcdefgx")), (4, list("ab")), (5, None)]
    items = spark.createDataFrame(rows, "id int, tokens array<string>").select("id", similarity.once(similarity.windows("tokens", 3)).alias("windows"))
    groups = similarity.profiles(items, ["id"])
    assert sorted((r.profile.id, r.members, r.total) for r in groups.collect()) == [(1, 2, 6), (3, 1, 6)]
    assert [(r.a.id, r.b.id, round(r.confidence, 4)) for r in similarity.overlaps(groups).collect()] == [(1, 3, 0.8333)]
    assert similarity.overlaps(groups, least=0.9).count() == 0


def test_overlaps_against_all_pairs(spark):
    rng, rows = random.Random(3), []
    base = [[rng.randrange(40) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    for i in range(120):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = rng.randrange(60)
        rows.append((i, rng.choice("pq"), own + [1, 1, 2]))
    groups = similarity.profiles(spark.createDataFrame(rows, "id int, kind string, windows array<long>"), ["id"], ["kind"])
    own = [(r.profile.id, r.kind, Counter(r.windows), r.total) for r in groups.collect()]
    slow = {(a, b): sum((x & y).values()) / max(s, t) for a, k, x, s in own for b, m, y, t in own if a < b and k == m and sum((x & y).values()) / max(s, t) >= 0.7}
    found = {(r.a.id, r.b.id): r.confidence for r in similarity.overlaps(groups, ["kind"]).collect()}
    assert len(slow) > 20 and found == slow


def test_equal_classes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, v string")
    assert sorted((r.id, r.first.id, r.members) for r in similarity.equal_classes(rows, ["id"], ["v"]).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_relational(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("l", "a", 1), ("l", "b", 1)], "k string, g string, v int")
    assert [tuple(r) for r in relational.single_group(rows, ["k"], "g", "v").collect()] == [("k", "a", 2, [1, 2])]
    one = spark.createDataFrame([("k",), ("z",)], "k string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in relational.first_match(one, rows, ["k"], F.col("v"), ["g", "v"]).collect()] == [("k", "a", 1)]
    assert sorted(r.k for r in relational.for_all(rows, spark.createDataFrame([("a",)], "g string"), ["k"], ["g"]).collect()) == ["k"]
    order = spark.createDataFrame([("src/a.ts",), ("src/a/b.ts",), ("x.ts",)], "p string").orderBy(relational.path_order("p"))
    assert [r.p for r in order.collect()] == ["src/a/b.ts", "src/a.ts", "x.ts"]
    assert [r[0] for r in order.select(relational.parent_dir("p")).collect()] == ["src/a", "src", ""]


def test_text_windows(spark):
    text = "a B\tc\n\rd  e f\x0bg " * 30
    rows = spark.createDataFrame([(1, text), (2, "a b"), (3, None), (4, text + "h")], "id int, text string")
    found = {r.id: list(r.w) for r in rows.select("id", similarity.text_windows("text", " \t\n\r", 4).alias("w")).collect()}
    tokens = [w for w in re.split("[ \t\n\r]+", text) if w]
    assert (found[2], found[3]) == ([], []) and len(found[1]) == len(tokens) - 3 and found[4][:-1] == found[1]
    runs = [tuple(tokens[i : i + 4]) for i in range(len(tokens) - 3)]
    assert len(set(zip(runs, found[1]))) == len(set(runs)) == len(set(found[1]))


def test_overlaps_of_long_items_take_time_by_their_length(spark):
    began = time.monotonic()
    rows = [(1, list(range(60_000))), (2, list(range(50_000)) + list(range(70_000, 80_000))), (3, list(range(100_000, 160_000)))]
    groups = similarity.profiles(spark.createDataFrame(rows, "id int, windows array<long>"), ["id"])
    assert [(r.a.id, r.b.id, round(r.confidence, 4)) for r in similarity.overlaps(groups).collect()] == [(1, 2, 0.8333)]
    assert time.monotonic() - began < 60
