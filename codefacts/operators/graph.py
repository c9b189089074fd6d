"""Graph operators on edge tables; they know nothing of programs or languages.

Nodes are of any orderable type. ``group`` names columns that keep graphs apart (a program, a root):
all joins carry them, so that many graphs are worked on at once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.storage import saved

#: Work (edges, times labels) of one group up to which it is done inside one task; larger groups go round by round.
IN_TASK = 2_000_000
#: Work of all groups that one task takes.
A_TASK = 250_000


def in_degree(edges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """node, in_degree: edges that end there, each call site counted."""
    return edges.groupBy(*group, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def reachable(edges: DataFrame, roots: DataFrame, group: Sequence[str] = (), label: Sequence[str] = ()) -> DataFrame:
    """The nodes (group, label, node) on a path from the roots (group, label, node), roots included.

    edges: group, src, dst. With ``label`` the closure is found for each label by itself. Groups are
    searched inside tasks, many in one, all in one shuffle. Those with more than IN_TASK edges times labels, and a graph
    without groups, go round by round as joins, whose frontier alone is shuffled, each round written down. An
    edge or root with a null is no part of any path.
    """
    keys = [*group, *label]
    roots = saved(roots.select(*keys, "node").dropna().distinct(), "roots")
    edges = saved(edges.select(*group, "src", "dst").dropna().distinct(), "edges")
    if not group:
        return _rounds(edges, roots, [], keys)
    many = roots.groupBy(*group).agg(F.count_distinct(*[F.col(c) for c in label or ["node"]]).alias("labels"))
    work = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(many, [*group])
    small, large, tasks = _dealt(work.withColumn("work", F.col("n") * (F.col("labels") if label else F.lit(1))), list(group))
    found = _in_tasks(small(edges), small(roots), list(group), list(label), tasks)
    return found if large is None else found.unionByName(_rounds(large(edges), large(roots), list(group), keys))


def _dealt(work: DataFrame, group: list[str]) -> tuple[Callable, Callable | None, int]:
    """Filters of the groups that are done in tasks and of the larger ones (None if there is none), and how many tasks. work: group, work."""
    total, most = work.agg(F.sum("work"), F.max("work")).first()
    tasks = max(1, -(-(total or 0) // A_TASK), min(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // 4096))
    if (most or 0) <= IN_TASK:
        return lambda df: df, None, tasks
    heavy = saved(work.where(F.col("work") > IN_TASK).select(*group), "heavy")
    return lambda df: df.join(heavy, group, "left_anti"), lambda df: df.join(heavy, group, "left_semi"), tasks


def _rounds(edges: DataFrame, roots: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    seen = frontier = roots
    following = edges.withColumnRenamed("src", "node")
    while not frontier.isEmpty():
        step = frontier.join(following, [*group, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(seen, [*keys, "node"], "left_anti"), "reached")
        seen = seen.unionByName(frontier)
    return seen


def _in_tasks(edges: DataFrame, roots: DataFrame, group: list[str], label: list[str], tasks: int) -> DataFrame:
    names = [*group, *label, "node"]
    schema = ", ".join(f"`{c}` {roots.schema[c].dataType.simpleString()}" for c in names)
    g = len(group)

    def closure(key: tuple, own: pa.Table, start: pa.Table) -> pa.Table:
        following: dict = {}
        for *of, a, b in zip(*(own.column(c).to_pylist() for c in [*group, "src", "dst"])):
            following.setdefault((*of, a), []).append(b)
        first: dict = {}
        for row in zip(*(start.column(c).to_pylist() for c in names)):
            first.setdefault(row[:-1], []).append(row[-1])
        out: list[list] = [[] for _ in names]
        for of, nodes in first.items():
            seen, queue, where = set(nodes), deque(nodes), of[:g]
            while queue:
                for n in following.get((*where, queue.popleft()), ()):
                    if n not in seen:
                        seen.add(n)
                        queue.append(n)
            for column, value in zip(out, of):
                column += [value] * len(seen)
            out[-1] += seen
        return pa.table([pa.array(c, type=start.schema.field(n).type) for c, n in zip(out, names)], names=names)

    dealt = lambda df: df.withColumn("task", F.pmod(F.xxhash64(*group), F.lit(tasks))).groupBy("task")
    return dealt(edges).cogroup(dealt(roots)).applyInArrow(closure, schema)


def forest_paths(edges: DataFrame, eligible: DataFrame, group: Sequence[str] = (), least: int = 3) -> DataFrame:
    """group, path: the maximal paths that begin with an edge from a node that is not eligible to one that is.

    edges: group, src, dst; eligible: group, node, each with one incoming edge at most, so that paths
    never merge. A path is emitted at its leaf if it has ``least`` nodes; cycles of eligible
    nodes are never entered. Groups of at most IN_TASK edges are walked inside tasks, many in one; larger ones, and a graph
    without groups, by one join for each step of the longest path.
    """
    g = list(group)
    inside = eligible.select(*g, "node").distinct()
    to_inside = edges.select(*g, "src", "dst").distinct().join(inside.withColumnRenamed("node", "dst"), [*g, "dst"])
    flagged = to_inside.join(inside.withColumnRenamed("node", "src").withColumn("within", F.lit(True)), [*g, "src"], "left")
    steps = saved(flagged.select(*g, "src", "dst", F.coalesce("within", F.lit(False)).alias("within")), "steps")
    if not g:
        return _step_by_step(steps, g, least)
    small, large, tasks = _dealt(steps.groupBy(*g).agg(F.count(F.lit(1)).alias("work")), g)
    node = steps.schema["src"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {steps.schema[c].dataType.simpleString()}" for c in g) + f", path array<{node}>"

    def walk(key: tuple, own: pa.Table) -> pa.Table:
        onward: dict = {}
        heads = []
        for *of, a, b, within in zip(*(own.column(c).to_pylist() for c in [*g, "src", "dst", "within"])):
            if within:
                onward.setdefault((*of, a), []).append(b)
            else:
                heads.append((tuple(of), [a, b]))
        out = []
        while heads:
            of, path = heads.pop()
            while (following := onward.get((*of, path[-1]))) and len(following) == 1:
                path.append(following[0])
            if following:
                heads += [(of, [*path, n]) for n in following]
            elif len(path) >= least:
                out.append((*of, path))
        types = [own.schema.field(c).type for c in g] + [pa.list_(own.schema.field("src").type)]
        return pa.table([pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=[*g, "path"])

    dealt = small(steps).withColumn("task", F.pmod(F.xxhash64(*g), F.lit(tasks)))
    found = dealt.groupBy("task").applyInArrow(walk, schema)
    return found if large is None else found.unionByName(_step_by_step(saved(large(steps), "steps"), g, least))


def _step_by_step(steps: DataFrame, g: list[str], least: int) -> DataFrame:
    between = steps.where("within").select(*g, F.col("src").alias("last"), "dst")
    onward = between.select(*g, "last").distinct()
    paths = steps.where("not within").select(*g, F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    done = None
    while True:
        leaves = paths.join(onward, [*g, "last"], "left_anti").where(F.size("path") >= least).select(*g, "path")
        done = leaves if done is None else done.unionByName(leaves)
        longer = paths.join(between, [*g, "last"]).where(~F.array_contains("path", F.col("dst")))
        paths = saved(longer.select(*g, F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")), "paths")
        if paths.isEmpty():
            return done
