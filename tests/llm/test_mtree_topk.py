import math
import random

import numpy as np
import pytest

from codefacts.llm import mtree_topk as mt


def brute(rows, k=5, every=50):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in own if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, dim string")


def clustered(n, seed=1, d=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)]) for i in range(n)]


def test_against_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(mt, "PAGE", 200)
    rows = clustered(1200)
    same = rows[3][1]
    rows += [(2000 + i, same) for i in range(300)] + [(None, same), (3000, None), (3050, [math.nan] * 8), (3001, [None] * 8), (3100, [1.0, 2.0]), (3101, [2.0, 2.0]), (3150, []), (3151, []), (3102, [math.inf] * 8)]
    assert sorted(map(tuple, mt.op4(vectors(rows)).collect())) == brute(rows)
    assert mt.op4(vectors([])).collect() == []


def test_huge_components(vectors):
    rows = [(i, [float(np.float32((i - 5) * 1e6)), float(i)]) for i in range(12)]
    found = sorted(map(tuple, mt.op4(vectors(rows), every=4).collect()))
    assert found == brute(rows, every=4)


def test_the_tree_is_exact_and_prunes():
    rows = clustered(4000, 2)
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    m2 = int((v * v).sum(axis=1).max())
    tree = mt.MTree(np.arange(len(v)), v, m2).thaw()
    sizes = sum(len(e) for leaf, e, _, _ in tree.nodes if leaf)
    assert sizes == len(v)
    for i in range(0, 4000, 200):
        scores = v @ v[i]
        best = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted((-s, j) for s, j in tree.search(i, v[i], 5, None)) == best
    # Far fewer distances than a scan takes.
    assert tree.measured < 0.3 * 20 * len(v)


def test_shuffled_pages_follow_the_searches(vectors, monkeypatch):
    """A tree goes to the blocks of queries that search it and to no others."""
    monkeypatch.setattr(mt, "PAGE", 100)
    monkeypatch.setattr(mt, "BLOCK", 8)
    monkeypatch.setattr(mt, "PIVOTS", 24)
    sent = []
    rows = clustered(3000, 4, 6)
    docs = vectors(rows)
    own = mt.quantised(docs, "vec_id", "embedding", 256)
    saved = mt.saved

    def counted(df, name, **options):
        out = saved(df, name, **options)
        if name in ("home", "rest"):
            sent.append(out.select("dim", "grp", "tree", "block").distinct().count())
        if name == "trees":
            sent.append(out.count())
        return out

    monkeypatch.setattr(mt, "saved", counted)
    queries = own.where("vec_id % 25 = 0")
    assert sorted(map(tuple, mt.topk(own, queries).collect())) == brute(rows, every=25)
    trees, home, rest = sent
    blocks = -(-120 // 8)
    # Clusters far from a query are never opened: well under every tree for every block.
    assert home <= 120 and home + rest < 0.7 * trees * blocks


def test_blocks_hold_the_queries_of_many_pivots(vectors, monkeypatch):
    """What is shuffled grows with trees times blocks: few queries of many pivots are one block, not one for each pivot."""
    monkeypatch.setattr(mt, "PAGE", 100)
    monkeypatch.setattr(mt, "PIVOTS", 24)
    monkeypatch.setattr(mt, "TILE", 16)
    monkeypatch.setattr(mt, "SLAB", 64)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    sent, saved = [], mt.saved

    def counted(df, name, **options):
        out = saved(df, name, **options)
        if name == "rest":
            sent.extend(out.collect())
        return out

    monkeypatch.setattr(mt, "saved", counted)
    own = mt.quantised(vectors(rows), "vec_id", "embedding", 256)
    assert sorted(map(tuple, mt.topk(own, own.where("vec_id % 10 = 0")).collect())) == brute(rows, every=10)
    assert len({r.grp for r in sent}) > 4 and len({r.block for r in sent}) == 1


@pytest.mark.parametrize("scale", [100, 1 << 15, 1 << 27])
def test_queries_that_descend_together(scale, monkeypatch):
    """Single floats, doubles and plain integers."""
    monkeypatch.setattr(mt, "TILE", 16)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-scale, scale, (900, 6)), np.tile(rng.integers(-scale, scale, (1, 6)), (300, 1))])
    m2 = int((v.astype(object) ** 2).sum(axis=1).max())
    trees = [mt.MTree(np.arange(len(v))[k::2], v[k::2], m2).thaw() for k in range(2)]
    asked = np.arange(0, len(v), 25)
    found = mt.Searches(asked, v[asked], 5, [None] * len(asked), m2)
    for tree in trees:
        found.through(tree, np.zeros(len(asked), bool))
    best = {}
    for q, i, s in zip(*found.results().to_pydict().values()):
        best.setdefault(q, []).append((-s, i))
    for q in asked.tolist():
        scores = v.astype(object) @ v[q].astype(object)
        assert sorted(best[q])[:5] == sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
