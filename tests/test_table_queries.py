"""Queries over tables on rows that the given tables do not hold."""

from codefacts.plans import table_queries


def test_forward_join_in_a_long_chain(spark, monkeypatch):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(1009)], "cust long, src long, dst long").coalesce(1)
    path = spark.createDataFrame([(1, list(range(1010)))], "cust long, path array<long>").coalesce(1)
    monkeypatch.setattr(table_queries, "order_edges", lambda spark, sf_dir: edges)
    monkeypatch.setattr(table_queries.graph, "forest_paths", lambda *given: path)
    assert [tuple(r) for r in table_queries.q_forward_join(spark, "").collect()] == [(0, 1)]
