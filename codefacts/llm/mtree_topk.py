"""Exact top-k inner products by best-first search in M-trees.

Inner products become a metric by one more component: with M2 the largest squared norm, x goes to
(x, sqrt(M2 - |x|^2)) and a query to (q, 0), and the squared distance is |q|^2 + M2 - 2 q.x: the nearest
has the largest product. Rows are dealt to their nearest pivot (PIVOTS at most, a bounded sample) and, by their
distance to it, to the pivot's rings (RINGS at most); a ring's rows make trees of about PAGE rows. A tree is a set of paged metric nodes: each entry stores its
distance to the node's centre, an inner entry also its covering radius. A search takes nodes in order
of their lower bounds; entries that the stored distances rule out by the triangle inequality are
passed over without a distance being computed; products of the rest are exact integers.

First each query searches one tree, of the ring around its own pivot that is nearest; then all other trees whose
pivot's ball and ring the k-th product found so far leaves possible. Queries go in blocks (BLOCK at most, of pivots that lie
near each other), trees in shelves (SHELF rows); a task searches a shelf's trees for one block, and a tree goes to the blocks
that may need it and to no others. What is shuffled so grows with the trees times the blocks, not with the searches. Inside a task
many queries descend a tree together: those that a node's ball rules out are passed over, products of the rest are one matrix product.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; vectors of different lengths do not meet; rows with the query's own id are not its candidates;
repeated query rows answer once, repeated candidates each take a rank; ties go to the smaller id; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns take no part. Squared norms beyond 2^52 are handled by plain integers without pruning;
scores beyond 64 bits are held at the largest or smallest of them.
"""

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import saved, sliced

PAGE, PIVOTS, RINGS, BLOCK, LEAF, FAN_OUT = 4096, 1024, 64, 1 << 18, 192, 32
#: Rows of a shelf of trees, and the shelves of small tables.
SHELF, LEAST_SHELVES = 1 << 18, 24
#: Queries that descend a tree together, and rows whose products with them are taken at once.
TILE, SLAB = 1024, 512
EXACT = 1 << 52
#: Products of norms below which sums of products are whole numbers in doubles and in single floats.
IN_DOUBLES, IN_FLOATS = 1 << 104, 1 << 48
#: Squared norms below which components are two bytes.
SHORT = 1 << 30


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v (whole numbers) of the rows that take part."""
    x = F.col("e")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~odd)
    return own.select("vec_id", F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def lifted(v: np.ndarray, m2: int) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(axis=1)))[:, None]], axis=1)


def gaps(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


class MTree:
    """Nodes: (is_leaf, entries, distances to the centre, radii); entries are rows of a leaf, nodes of an inner one."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, m2: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.m2 = ids[order], v[order], m2
        self.points = lifted(self.v, m2)
        self.nodes: list[tuple] = []
        #: Distances and products computed by searches.
        self.measured = 0
        self.centres: list[np.ndarray] = []
        self.root, self.radius = self._load(np.arange(len(ids)), self.points.mean(axis=0))
        self.centre = self.centres[self.root]
        self.middles = np.array(self.centres)
        # Rows of one leaf lie next to each other.
        order = np.concatenate([e for leaf, e, _, _ in self.nodes if leaf])
        self.ids, self.v, at = self.ids[order], self.v[order], 0
        for i, (leaf, entries, apart, radii) in enumerate(self.nodes):
            if leaf:
                self.nodes[i] = (leaf, np.arange(at, at := at + len(entries), dtype=np.int32), apart, radii)
        del self.points, self.centres

    def thaw(self) -> "MTree":
        """A tree read from its pages; exact products of moderate vectors are taken in doubles."""
        self.floats = self.v.astype(np.float64) if self.m2 < EXACT else None
        return self

    def _load(self, rows: np.ndarray, centre: np.ndarray) -> tuple[int, float]:
        """Bulk loading: rows go to the nearest of a few of them, as many as pages are needed, until a page holds them."""
        away = gaps(self.points[rows], centre)
        radius = float(away.max(initial=0.0))
        if len(rows) <= LEAF or radius == 0:
            pages = [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)] or [rows]
            if len(pages) == 1:
                return self._add((True, rows, away, None), centre), radius
            own = [self._add((True, p, gaps(self.points[p], centre), None), centre) for p in pages]
            return self._add((False, np.array(own), np.zeros(len(own)), np.full(len(own), radius)), centre), radius
        fan = min(FAN_OUT, -(-3 * len(rows) // (2 * LEAF)))
        seeds = self.points[rows[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        near = (((seeds * seeds).sum(axis=1)[None, :]) - 2 * self.points[rows] @ seeds.T).argmin(axis=1)
        parts = [rows[near == s] for s in range(fan) if (near == s).any()]
        if len(parts) == 1:
            parts = np.array_split(rows, fan)
        own, apart, radii = [], [], []
        for part in parts:
            middle = self.points[part].mean(axis=0)
            node, r = self._load(part, middle)
            own.append(node)
            apart.append(float(np.sqrt(((middle - centre) ** 2).sum())))
            radii.append(r)
        return self._add((False, np.array(own), np.array(apart), np.array(radii)), centre), radius

    def _add(self, node: tuple, centre: np.ndarray) -> int:
        self.nodes.append(node)
        self.centres.append(centre)
        return len(self.nodes) - 1

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows of another id whose score reaches least."""
        m2, wide = self.m2, self.m2 >= EXACT
        qf = np.append(q.astype(np.float64), 0.0)
        q2 = float(qf @ qf)
        reach = lambda s: math.inf if wide or s is None else math.sqrt(max(0.0, q2 + m2 - 2 * s)) * (1 + 1e-9) + 1e-6 * (1 + math.sqrt(m2))
        bound, best = reach(least), []
        away = float(np.sqrt(((qf - self.centre) ** 2).sum()))
        heap = [(max(0.0, away - self.radius), self.root, away)]
        while heap:
            low, at, away = heapq.heappop(heap)
            if low > bound:
                break
            leaf, entries, apart, radii = self.nodes[at]
            if leaf:
                rows = entries[np.abs(away - apart) <= bound]
                if not len(rows):
                    continue
                self.measured += len(rows)
                scores = self.v[rows].astype(object) @ q.astype(object) if wide else self.floats[rows] @ qf[:-1]
                floor = best[0][0] if len(best) == k else least
                if floor is not None:
                    # Entries below the k-th product are done with at once.
                    over = np.flatnonzero(scores >= floor)
                    rows, scores = rows[over], scores[over]
                for s, i in zip(scores.tolist(), self.ids[rows].tolist()):
                    s = int(s)
                    if i != query_id and (len(best) < k or (s, -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (s, -i))
                if len(best) == k:
                    bound = min(bound, reach(best[0][0]))
                continue
            # Stored distances first; only what they leave is measured.
            left = np.flatnonzero(np.abs(away - apart) - radii <= bound)
            if len(left):
                self.measured += len(left)
                to = gaps(self.middles[entries[left]], qf)
                low = np.maximum(0.0, to - radii[left])
                for i in np.flatnonzero(low <= bound).tolist():
                    heapq.heappush(heap, (float(low[i]), int(entries[left[i]]), float(to[i])))
        return [(s, -i) for s, i in best]


class Searches:
    """Queries (whole numbers) that go through trees together, each with its k best rows so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: list[int | None], m2: int) -> None:
        self.ids, self.k, self.m2 = ids, k, m2
        self.q2 = (q.astype(np.float64) ** 2).sum(axis=1)
        both = float(self.q2.max(initial=0.0)) * m2
        #: Single rows by plain integers where products leave the doubles.
        self.wide = m2 >= EXACT or both >= IN_DOUBLES
        self.kind = np.float32 if both < IN_FLOATS else np.float64
        self.whole, self.least = (q, least) if self.wide else (None, None)
        self.q = None if self.wide else q.astype(self.kind)
        self.floor = np.array([-np.inf if x is None else x for x in least], np.float64)
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.work = 0, np.empty(TILE * SLAB, self.kind)
        self.loose: list[tuple[int, int, int]] = []

    def reach(self, at: np.ndarray) -> np.ndarray:
        """The distance within which rows may still be among the best."""
        return np.sqrt(np.maximum(0.0, self.q2[at] + self.m2 - 2 * self.floor[at])) * (1 + 1e-9) + 1e-6 * (1 + math.sqrt(self.m2))

    def away(self, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d2 = self.q2[at][:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (self.q[at].astype(np.float64) @ centres[:, :-1].T)
        return np.sqrt(np.maximum(d2, 0.0))

    def through(self, tree: MTree, skip: np.ndarray) -> None:
        """Search a tree for all queries but those to skip."""
        asked = np.flatnonzero(~skip)
        if self.wide:
            for i in asked.tolist():
                self.loose += [(int(self.ids[i]), vec, s) for s, vec in tree.search(int(self.ids[i]), self.whole[i], self.k, self.least[i])]
            return
        rows = tree.v.astype(self.kind)
        for start in range(0, len(asked), TILE):
            at = asked[start : start + TILE]
            at = at[self.away(at, tree.centre[None, :])[:, 0] - tree.radius <= self.reach(at)]
            if len(at):
                self.descend(tree, rows, at)

    def descend(self, tree: MTree, rows: np.ndarray, at: np.ndarray) -> None:
        heap = [(0.0, tree.root, at)]
        while heap:
            _, node, at = heapq.heappop(heap)
            leaf, entries, _, radii = tree.nodes[node]
            if leaf:
                self.scan(tree, rows, at, int(entries[0]), int(entries[-1]) + 1) if len(entries) else None
                continue
            low = self.away(at, tree.middles[entries]) - radii
            open_ = low <= self.reach(at)[:, None]
            # Leaves that lie next to each other are read together.
            leaves: list[tuple[int, int, int]] = []
            for i in np.flatnonzero(open_.any(axis=0)).tolist():
                child = tree.nodes[entries[i]]
                if child[0] and len(child[1]):
                    leaves.append((int(child[1][0]), int(child[1][-1]) + 1, i))
                elif not child[0]:
                    heapq.heappush(heap, (float(low[:, i].min()), int(entries[i]), at[open_[:, i]]))
            leaves.sort()
            while leaves:
                n = 1
                while n < len(leaves) and leaves[n][0] == leaves[n - 1][1] and leaves[n][1] - leaves[0][0] <= SLAB:
                    n += 1
                self.scan(tree, rows, at[open_[:, [i for _, _, i in leaves[:n]]].any(axis=1)], leaves[0][0], leaves[n - 1][1])
                leaves = leaves[n:]

    def scan(self, tree: MTree, rows: np.ndarray, at: np.ndarray, start: int, stop: int) -> None:
        """Products of these queries and the rows of a slab; those that reach the floor are held."""
        own = self.q[at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else self.q[at]
        for first in range(start, stop, SLAB):
            some = rows[first : min(first + SLAB, stop)]
            scores = np.matmul(own, some.T, out=self.work[: len(at) * len(some)].reshape(len(at), len(some)))
            over = np.flatnonzero(scores.max(axis=1) >= self.floor[at])
            if len(over):
                over_scores, of = scores[over], at[over]
                r, c = np.nonzero(over_scores >= self.floor[of][:, None])
                ids, of = tree.ids[first + c], of[r]
                other = ids != self.ids[of]
                self.hits.append((of[other], over_scores[r, c][other].astype(np.float64), ids[other]))
                self.held += int(other.sum())
        if self.held > 1 << 14:
            self.settle()

    def settle(self) -> None:
        """Held rows go to the best of their queries."""
        if not self.hits:
            return
        of, scores, ids = (np.concatenate([h[c] for h in self.hits]) for c in range(3))
        self.hits, self.held = [], 0
        own = np.unique(of)
        of = np.concatenate([of, np.repeat(own, self.k)])
        scores, ids = np.concatenate([scores, self.scores[own].ravel()]), np.concatenate([ids, self.found[own].ravel()])
        order = np.lexsort((ids, -scores, of))
        starts = np.searchsorted(of[order], own)
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[own], self.found[own] = scores[best], ids[best]
        self.floor[own] = np.maximum(self.floor[own], self.scores[own, -1])

    def results(self) -> pa.Table:
        """query_id, vec_id, score of all that is left."""
        self.settle()
        row, rank = np.nonzero(self.scores > -np.inf)
        held = [(q, i, max(-(1 << 63), min(s, (1 << 63) - 1))) for q, i, s in self.loose]
        columns = [self.ids[row], self.found[row, rank], self.scores[row, rank].astype(np.int64)]
        if self.wide:
            columns = [[h[c] for h in held] for c in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def chained(points: np.ndarray) -> list[int]:
    """All points, each followed by the nearest one that is left."""
    order, left = [0], list(range(1, len(points)))
    while left:
        gap = ((points[left] - points[order[-1]]) ** 2).sum(axis=1)
        order.append(left.pop(int(gap.argmin())))
    return order


def topk(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score. rows, queries: vec_id and v of whole numbers."""
    spark = rows.sparkSession
    rows = saved(rows.withColumn("dim", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n_rows, m2 = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m2 = int(m2)
    # Components are moved in as few bytes as hold them.
    q2 = queries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0
    kind = "short" if max(m2, q2) < SHORT else "long"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    many = min(PIVOTS, max(8, n_rows // PAGE))
    pivots: dict[int, np.ndarray] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).collect():  # PIVOTS at most
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {d: lifted(np.array(v, dtype=np.int64).reshape(len(v), d), m2) for d, v in pivots.items()}

    def nearest(dim: int, v: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and all distances; pivot 0 where the length has none."""
        own = pivots.get(dim)
        if own is None:
            return np.zeros(len(v), np.int64), np.zeros((len(v), 0))
        p = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1) if query else lifted(v, m2)
        d2 = (p * p).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * p @ own.T
        return d2.argmin(axis=1), np.sqrt(np.maximum(d2, 0.0))

    def dealt(batches):
        for batch in sliced(batches, 4096):
            dims, group, away = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                g, all_d = nearest(d, matrix(batch.column("v").take(pa.array(at)), d))
                group[at] = g
                if all_d.shape[1]:
                    away[at] = all_d[np.arange(len(at)), g]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(group), pa.array(away)], names=["vec_id", "v", "dim", "grp", "away"])

    assigned = saved(rows.select("vec_id", "v", "dim").mapInArrow(dealt, f"vec_id long, v array<{kind}>, dim int, grp long, away double"), "assigned")
    cuts = F.percentile_approx("away", [(i + 1) / RINGS for i in range(RINGS - 1)], 1000)
    groups = assigned.groupBy("dim", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), cuts.alias("cuts"))
    groups = saved(groups.withColumn("trees", F.ceil(F.col("n") / PAGE)), "groups")
    #: Of lengths without a pivot nothing is known: such groups have one ring and are searched whole, by their own queries only.
    radii = {(r["dim"], r["grp"]): r["radius"] for r in groups.where(F.col("dim").isin(list(pivots))).select("dim", "grp", "radius").collect()}  # PIVOTS at most
    # The ring by distance, as many as there are trees; a ring with several trees deals its rows by hash.
    below = F.size(F.filter("cuts", lambda c: c < F.col("away")))
    rings, ring = F.least(F.col("trees"), F.lit(RINGS)), F.floor(below * F.least(F.col("trees"), F.lit(RINGS)) / RINGS)
    each_ring = F.ceil(F.col("trees") / rings)
    with_tree = assigned.join(groups.select("dim", "grp", "trees", "cuts"), ["dim", "grp"]).withColumn("tree", ring * each_ring + F.pmod(F.xxhash64("vec_id"), each_ring))

    def build(key, group):
        d = key[0].as_py()
        tree = MTree(group.column("vec_id").to_numpy(), matrix(group.column("v"), d), m2)
        away = group.column("away").to_numpy()
        row = {"dim": d, "grp": key[1].as_py(), "tree": key[2].as_py(), "least_away": float(away.min()), "most_away": float(away.max()), "pages": pickle.dumps(tree, 5)}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("grp", pa.int64()), ("tree", pa.int64()), ("least_away", pa.float64()), ("most_away", pa.float64()), ("pages", pa.binary())]))

    trees = saved(with_tree.select("dim", "grp", "tree", "vec_id", "v", "away").groupBy("dim", "grp", "tree").applyInArrow(build, "dim int, grp long, tree long, least_away double, most_away double, pages binary"), "trees")
    placed = trees.drop("pages")
    asked = saved(queries.select(F.col("vec_id").alias("query_id"), F.col("v").cast(f"array<{kind}>").alias("q")).distinct().withColumn("dim", F.size("q")), "queries")

    def own(batches):
        for batch in sliced(batches, 4096):
            dims, group, away = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                g, all_d = nearest(d, matrix(batch.column("q").take(pa.array(at)), d), True)
                group[at] = g
                if all_d.shape[1]:
                    away[at] = all_d[np.arange(len(at)), g]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(away)], names=[*batch.schema.names, "grp", "away"])

    def search(key, left, right):
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        d = key[0].as_py()
        searches = Searches(right.column("query_id").to_numpy(), matrix(right.column("q"), d), k, right.column("least").to_pylist(), m2)
        homes = [right.column(c).to_numpy() for c in ("home_grp", "home_tree")]
        for i in range(len(left)):
            grp, tree = left.column("grp")[i].as_py(), left.column("tree")[i].as_py()
            at_home = (homes[0] == grp) & (homes[1] == tree)
            pages = pickle.loads(left.column("pages")[i].as_py()).thaw()
            # At home first, then all others: no tree is searched twice for a query.
            searches.through(pages, at_home if key[2].as_py() >= 0 else ~at_home)
        return searches.results()

    def searched(pairs: DataFrame, sent: DataFrame) -> DataFrame:
        """pairs: dim, block, shelf, grp, tree; sent: dim, block, shelf and the queries that go there."""
        keys = ("dim", "block", "shelf")
        paged = pairs.join(trees.select("dim", "grp", "tree", "pages"), ["dim", "grp", "tree"]).select(*keys, "grp", "tree", "pages")
        sent = sent.select(*keys, "query_id", "q", "home_grp", "home_tree", "least")
        # New column identities: both sides come from one table.
        paged, sent = paged.toDF(*paged.columns), sent.toDF(*sent.columns)
        return paged.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    homed = saved(asked.mapInArrow(own, f"query_id long, q array<{kind}>, dim int, grp long, away double"), "homed")
    # A block holds queries of one pivot or of several that lie near each other: they search much the same trees.
    asking = homed.groupBy("dim", "grp").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["dim"], r["grp"]): r["n"] for r in asking.where(F.col("dim").isin(list(pivots))).collect()}  # PIVOTS at most
    blocks: dict[tuple[int, int], tuple[int, int]] = {}
    block = 0
    for d, points in pivots.items():
        inside = 0
        for g in chained(points):
            n = counts.get((d, g), 0)
            if inside and inside + n > BLOCK:
                block, inside = block + 1, 0
            parts = max(1, -(-n // BLOCK))
            blocks[d, g] = (block, parts)
            block, inside = (block + parts, 0) if parts > 1 else (block, inside + n)
        block += 1
    placing = spark.createDataFrame([(d, g, at, parts) for (d, g), (at, parts) in blocks.items()], "dim int, grp long, at long, of long")
    # Lengths without a pivot: blocks of their own.
    apart = asking.select("dim", "grp", F.ceil(F.col("n") / BLOCK).alias("own_of"))
    homed = homed.join(apart, ["dim", "grp"]).join(F.broadcast(placing), ["dim", "grp"], "left")
    homed = homed.withColumn("block", F.coalesce("at", F.lit(0)) + F.pmod(F.xxhash64("query_id"), F.coalesce("of", "own_of"))).drop("at", "of", "own_of")
    gap = F.greatest(F.col("least_away") - F.col("away"), F.col("away") - F.col("most_away"), F.lit(0.0))
    home = homed.join(placed, ["dim", "grp"]).groupBy("query_id", "q", "dim", "block", "grp").agg(F.min_by("tree", F.struct(gap.alias("gap"), "tree")).alias("tree"))
    home = saved(home, "home")
    at_home = home.withColumnsRenamed({"grp": "home_grp", "tree": "home_tree"}).withColumn("least", F.lit(None).cast("long"))
    # A tree and the queries at home in it make a shelf; such shelves are negative, so that they are told from the others.
    own_shelf = lambda grp, tree: -1 - (F.col(grp) * (1 << 40) + F.col(tree))
    first = searched(home.select("dim", "block", "grp", "tree").distinct().withColumn("shelf", own_shelf("grp", "tree")), at_home.withColumn("shelf", own_shelf("home_grp", "home_tree")))
    first = saved(best(first).drop("rank"), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "least")
    asked = saved(at_home.drop("least").join(kth, "query_id", "left"), "asked")

    def others(batches):
        """Of each block, the groups that remain for some query, and between which distances to their pivot."""
        for batch in sliced(batches, 4096):
            out: dict[tuple[int, int, int], tuple[float, float]] = {}
            dims, block = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
            for d, own_block in sorted({*zip(dims.tolist(), block.tolist())}):
                at = np.flatnonzero((dims == d) & (block == own_block))
                if d not in pivots:
                    out[d, own_block, 0] = (-math.inf, math.inf)
                    continue
                part = batch.take(pa.array(at))
                q = matrix(part.column("q"), d)
                _, away = nearest(d, q, True)
                q2 = (q.astype(np.float64) ** 2).sum(axis=1)
                least = [None if m2 >= EXACT else x for x in part.column("least").to_pylist()]
                reach = np.array([math.inf if x is None else math.sqrt(max(0.0, a + m2 - 2 * x)) * (1 + 1e-9) + 1e-6 * (1 + math.sqrt(m2)) for x, a in zip(least, q2.tolist())])
                for g in range(away.shape[1]):
                    if (d, g) in radii:
                        left = away[:, g] - radii[d, g] <= reach
                        if left.any():
                            more = reach[left] * (1 + 1e-9) + 1e-6
                            out[d, own_block, g] = (float((away[left, g] - more).min()), float((away[left, g] + more).max()))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))), *(pa.array([x[c] for x in out.values()], pa.float64()) for c in range(2))], names=["dim", "block", "grp", "low", "high"])

    rest = asked.select("q", "dim", "block", "least").mapInArrow(others, "dim int, block long, grp long, low double, high double")
    rest = rest.groupBy("dim", "block", "grp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Of the groups that remain, the trees whose ring remains.
    rest = saved(rest.join(placed, ["dim", "grp"]).where("most_away >= low and least_away <= high").select("dim", "grp", "tree", "block"), "rest")
    shelves = max(LEAST_SHELVES, -(-n_rows // SHELF))
    rest = rest.withColumn("shelf", F.pmod(F.xxhash64("dim", "grp", "tree"), F.lit(shelves)))
    # Each block goes once to each shelf that it needs.
    second = searched(rest, asked.join(rest.select("dim", "block", "shelf").distinct(), ["dim", "block"]))
    return best(first.unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    rows = quantised(embeddings, "vec_id", "embedding", scale)
    return topk(rows, rows.where(F.col("vec_id") % every == 0), k)


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
