"""The driver's contract."""

import __spark_entry__


def test_names_and_oracles():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len([q for q in queries if q.startswith("q_")]) >= 28
    assert all(q in oracle for q in queries if q.startswith("q_"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
