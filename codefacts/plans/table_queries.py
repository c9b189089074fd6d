"""The operators over the relational tables, each beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.findings import numbered
from codefacts.operators import graph, relational, similarity
from codefacts.operators import ranges as ranges_op
from codefacts.storage import saved


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_edges(spark: SparkSession, sf_dir: str, days: int = 60) -> DataFrame:
    """cust, src, dst: an order and each later order of the same customer within so many days."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    a = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("src"), F.col("o_orderdate").alias("at"))
    b = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("dst"), F.col("o_orderdate").alias("later"))
    pairs = a.join(b, "cust").where((F.col("later") > F.col("at")) & (F.col("later") <= F.col("at") + F.expr(f"interval {days} days")))
    return pairs.select("cust", "src", "dst")


EDGES = """ce AS (SELECT a.o_custkey AS cust, a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b
  ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 60 DAY)"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent finished orders."""
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("node"))


ROOTS = "roots AS (SELECT o_custkey AS cust, o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


def q_single_group_consumers(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    found = relational.single_group(lines.join(suppliers, "l_suppkey"), ["l_orderkey"], "s_nationkey", "l_suppkey").where("n_rows > 1")
    return found.select("l_orderkey", "s_nationkey", F.size("l_suppkey").cast("long").alias("n_suppliers"), "n_rows")


def q_in_degree(spark, sf_dir):
    return graph.in_degree(order_edges(spark, sf_dir))


def q_in_degree_one(spark, sf_dir):
    return graph.in_degree(order_edges(spark, sf_dir)).where("in_degree = 1").select("node")


def q_reachable(spark, sf_dir):
    return graph.reachable(order_edges(spark, sf_dir), roots(spark, sf_dir), ["cust"]).select("node")


def q_unreachable_nodes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))
    return orders.join(q_reachable(spark, sf_dir), "node", "left_anti")


def q_group_reachable(spark, sf_dir):
    labelled = roots(spark, sf_dir).withColumn("root", F.col("node"))
    return graph.reachable(order_edges(spark, sf_dir), labelled, ["cust"], ["root"]).select("root", "node")


def eligible(edges: DataFrame) -> DataFrame:
    return graph.in_degree(edges, ["cust"]).where("in_degree = 1").select("cust", "node")


def q_chain_paths(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    paths = graph.forest_paths(edges, eligible(edges), ["cust"])
    return paths.select("cust", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("n_nodes"))


CHAINS = """deg AS (SELECT dst AS node, count(*) AS n FROM ce GROUP BY dst), el AS (SELECT node FROM deg WHERE n = 1),
r AS (SELECT cust, src AS head, dst AS last, CAST(src AS VARCHAR) || '>' || CAST(dst AS VARCHAR) AS path, 2 AS n_nodes FROM ce
      WHERE dst IN (SELECT node FROM el) AND src NOT IN (SELECT node FROM el)
      UNION ALL SELECT r.cust, r.head, ce.dst, r.path || '>' || CAST(ce.dst AS VARCHAR), n_nodes + 1 FROM r JOIN ce ON ce.src = r.last WHERE ce.dst IN (SELECT node FROM el)),
chains AS (SELECT cust, path, CAST(n_nodes AS BIGINT) AS n_nodes FROM r
      WHERE n_nodes >= 3 AND NOT EXISTS (SELECT 1 FROM ce JOIN el ON ce.dst = el.node WHERE ce.src = r.last))"""


def q_forward_join(spark, sf_dir):
    """Orders with one successor, joined to it, except those inside a chain."""
    edges = saved(order_edges(spark, sf_dir), "order_edges")
    forwards = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src")
    inside = graph.forest_paths(edges, eligible(edges), ["cust"]).select(F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("src"))
    pairs = relational.first_match(forwards, edges, ["src"], F.col("dst"), ["dst"])
    return pairs.join(inside, "src", "left_anti").select("src", "dst")


def docs_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", similarity.once(similarity.text_windows("text", " \t\n\r")).alias("windows"))


def q_near_duplicate_docs(spark, sf_dir):
    """Pairs of distinct window profiles, each named by its first document, and the members of both."""
    groups = saved(similarity.profiles(docs_windows(spark, sf_dir), ["doc_id"]), "profiles")
    pairs = similarity.overlaps(groups)
    size = groups.select("profile", "members")
    named = pairs.join(size.select(F.col("profile").alias("a"), F.col("members").alias("n_a")), "a").join(size.select(F.col("profile").alias("b"), F.col("members").alias("n_b")), "b")
    return named.select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.round("confidence", 6).alias("confidence"), "n_a", "n_b")


def q_equal_window_classes(spark, sf_dir):
    """Each document of 50 tokens and more with the first document of equal windows."""
    items = docs_windows(spark, sf_dir)
    own = items.where(F.size("windows") > 0).select("doc_id", similarity.once(F.array_sort("windows")).alias("w")).withColumn("h", F.xxhash64("w"))
    classes = own.groupBy("h", "w").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return own.join(classes, ["h", "w"]).select("doc_id", "class_id", "class_size")


def q_equal_set_pairs(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_quantity", "l_returnflag").alias("field"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("field")).alias("fields")).where(F.size("fields") >= 3)
    pairs = similarity.equal_pairs(items, ["l_orderkey"], ["fields"])
    return pairs.select(F.col("a.l_orderkey").alias("order_a"), F.col("b.l_orderkey").alias("order_b"), F.size("a.fields").cast("long").alias("n_fields"))


def q_equal_sequence_classes(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    items = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count(F.lit(1)).alias("turns")).where("turns >= 3")
    classes = items.groupBy("roles").agg(F.min("conv_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return items.join(classes, "roles").select("conv_id", "class_id", "class_size")


def q_pass_through(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    days = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("event_type") == "click").alias("n_forwards"))
    return days.where("n_refs = n_forwards and n_forwards > 0").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_refs")


def q_for_all(spark, sf_dir):
    """Orders all of whose parts some supplier of nation 0 delivers in another order or this one."""
    lines = read(spark, sf_dir, "lineitem")
    near = read(spark, sf_dir, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    parts = lines.join(near, "l_suppkey", "left_semi").select("l_partkey")
    return relational.for_all(lines.select("l_orderkey", "l_partkey"), parts, ["l_orderkey"], ["l_partkey"])


def q_unreached_imports(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    reached = orders.join(returned, "o_orderkey", "left_semi").select("o_custkey")
    return orders.select("o_custkey").distinct().join(reached, "o_custkey", "left_anti")


def q_text_scan(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit("[A-Za-z0-9]+")).cast("long").alias("n_tokens"), (1 + F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("n_lines"))


def q_json(spark, sf_dir):
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read(spark, sf_dir, "events").groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def q_findings_ordered(spark, sf_dir):
    """Several results as findings of one kind, in one total order."""
    parts = [
        q_in_degree_one(spark, sf_dir).select(F.lit("in-degree one").alias("shape"), F.lit(1).alias("ord"), F.concat(F.lit("orders/"), F.col("node").cast("string")).alias("file"), F.col("node").cast("string").alias("subject")),
        q_unreached_imports(spark, sf_dir).select(F.lit("unreached").alias("shape"), F.lit(2).alias("ord"), F.concat(F.lit("customers/"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_custkey").cast("string").alias("subject")),
        q_pass_through(spark, sf_dir).select(F.lit("pass-through").alias("shape"), F.lit(3).alias("ord"), F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit("/"), F.col("day")).alias("file"), F.col("day").alias("subject")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return numbered(rows.orderBy(relational.path_order("file"), "subject", "ord")).select("place", "shape", "file", "subject")


def spans(spark, sf_dir):
    """Orders as points, and as ranges of days that begin with them and are as long as their price says."""
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    length = F.floor(F.col("o_totalprice") / 1000).cast("int")
    return o.select("o_custkey", F.col("o_orderkey").alias("point"), day.alias("at")), o.select("o_custkey", F.col("o_orderkey").alias("around"), day.alias("start"), (day + length).alias("end"))


def q_tightest_containing(spark, sf_dir):
    """Of the ranges of the same customer around each order's day the shortest."""
    points, ranges = spans(spark, sf_dir)
    found = ranges_op.tightest(points, ranges, ["o_custkey"], ["around"])
    return found.select(F.col("point.point").alias("o_orderkey"), F.col("range.around").alias("around"))


def q_first_inside(spark, sf_dir):
    """Of the orders of the same customer inside each range the one with the smallest key."""
    points, ranges = spans(spark, sf_dir)
    found = ranges_op.first_inside(ranges, points, ["o_custkey"], ["point"])
    return found.select(F.col("range.around").alias("around"), F.col("point.point").alias("o_orderkey"))


SPANS = """s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS at, CAST(floor(o_totalprice / 1000) AS INTEGER) AS size FROM orders),
m AS (SELECT p.o_orderkey AS point, r.o_orderkey AS around, r.size FROM s p JOIN s r ON p.o_custkey = r.o_custkey AND r.at <= p.at AND p.at < r.at + r.size)"""

WINDOWS = r"""t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_transform(range(1, len(w) - 48), lambda i: array_to_string(list_slice(w, i, i + 49), ' '))) AS gs FROM t WHERE len(w) >= 50)"""

SQL = {
    "q_single_group_consumers": """SELECT l_orderkey, min(s_nationkey) AS s_nationkey, count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n_rows
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey HAVING count(DISTINCT s_nationkey) = 1 AND count(*) > 1""",
    "q_in_degree": f"WITH {EDGES} SELECT dst AS node, count(*) AS in_degree FROM ce GROUP BY dst",
    "q_in_degree_one": f"WITH {EDGES} SELECT dst AS node FROM ce GROUP BY dst HAVING count(*) = 1",
    "q_reachable": f"WITH RECURSIVE {EDGES}, {ROOTS}, r AS (SELECT node FROM roots UNION SELECT dst FROM r JOIN ce ON ce.src = r.node) SELECT node FROM r",
    "q_unreachable_nodes": f"WITH RECURSIVE {EDGES}, {ROOTS}, r AS (SELECT node FROM roots UNION SELECT dst FROM r JOIN ce ON ce.src = r.node) SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT node FROM r)",
    "q_group_reachable": f"WITH RECURSIVE {EDGES}, {ROOTS}, r AS (SELECT node AS root, node FROM roots UNION SELECT root, dst FROM r JOIN ce ON ce.src = r.node) SELECT root, node FROM r",
    "q_chain_paths": f"WITH RECURSIVE {EDGES}, {CHAINS} SELECT cust, path, n_nodes FROM chains",
    "q_forward_join": f"""WITH RECURSIVE {EDGES}, {CHAINS}, inside AS (SELECT CAST(unnest(string_split(path, '>')[2:]) AS BIGINT) AS node FROM chains)
SELECT src, min(dst) AS dst FROM ce WHERE src NOT IN (SELECT node FROM inside) GROUP BY src HAVING count(*) = 1""",
    "q_near_duplicate_docs": f"""WITH {WINDOWS}, p AS (SELECT gs, min(doc_id) AS doc, count(*) AS members, len(gs) AS total FROM g GROUP BY gs),
c AS (SELECT doc, members, total, x, count(*) AS n FROM (SELECT doc, members, total, unnest(gs) AS x FROM p) GROUP BY ALL)
SELECT a.doc AS doc_a, b.doc AS doc_b, round(sum(least(a.n, b.n)) / greatest(a.total, b.total), 6) AS confidence, a.members AS n_a, b.members AS n_b
FROM c a JOIN c b ON a.x = b.x AND a.doc < b.doc GROUP BY a.doc, b.doc, a.total, b.total, a.members, b.members HAVING sum(least(a.n, b.n)) / greatest(a.total, b.total) >= 0.7""",
    "q_equal_window_classes": f"WITH {WINDOWS} SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id, count(*) OVER (PARTITION BY gs) AS class_size FROM g",
    "q_equal_set_pairs": """WITH i AS (SELECT l_orderkey, list_sort(list((l_quantity, l_returnflag))) AS fields FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3)
SELECT a.l_orderkey AS order_a, b.l_orderkey AS order_b, len(a.fields) AS n_fields FROM i a JOIN i b ON a.fields = b.fields AND a.l_orderkey < b.l_orderkey""",
    "q_equal_sequence_classes": """WITH i AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING count(*) >= 3)
SELECT conv_id, min(conv_id) OVER (PARTITION BY roles) AS class_id, count(*) OVER (PARTITION BY roles) AS class_size FROM i""",
    "q_pass_through": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_refs FROM events
GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (event_type = 'click')""",
    "q_for_all": """WITH near AS (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 0)
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey IN (SELECT l_partkey FROM near))""",
    "q_unreached_imports": """SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN
(SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')""",
    "q_text_scan": r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS BIGINT) AS n_tokens,
CAST(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS n_lines FROM documents""",
    "q_json": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
SQL["q_findings_ordered"] = f"""WITH one AS ({SQL["q_in_degree_one"]}), two AS ({SQL["q_unreached_imports"]}), three AS ({SQL["q_pass_through"]}),
u AS (SELECT 'in-degree one' AS shape, 1 AS ord, 'orders/' || node AS file, CAST(node AS VARCHAR) AS subject FROM one
UNION ALL SELECT 'unreached', 2, 'customers/' || o_custkey, CAST(o_custkey AS VARCHAR) FROM two
UNION ALL SELECT 'pass-through', 3, 'users/' || user_id || '/' || day, day FROM three)
SELECT row_number() OVER (ORDER BY string_split(file, '/'), subject, ord) AS place, shape, file, subject FROM u"""
SQL["q_tightest_containing"] = f"""WITH {SPANS}
SELECT point AS o_orderkey, arg_min(around, (size, around)) AS around FROM m GROUP BY point"""
SQL["q_first_inside"] = f"WITH {SPANS} SELECT around, min(point) AS o_orderkey FROM m GROUP BY around"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
