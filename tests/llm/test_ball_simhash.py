import random
import re

import numpy as np
import pytest
import xxhash

from codefacts.llm import ball_simhash as bs


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """Fingerprint -> smallest id reachable. fps: (id, fingerprint)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    values = sorted({f for _, f in fps})
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in values}


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 300))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(3 * n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_documents_against_brute_force(frame, odd_rows):
    rows = odd_rows + near_copies(4, 60)
    found = bs.op9(frame(rows)).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    of = slow_components(fps)
    assert sorted(map(tuple, found), key=repr) == sorted(((i, f"{f:016x}", of[f]) for i, f in fps), key=repr)


def test_links_of_dense_balls(spark, monkeypatch):
    rng, values = random.Random(7), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(300):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    values |= {rng.getrandbits(64) for _ in range(200)}
    for split in (False, True):
        if split:
            monkeypatch.setattr(bs, "hot_limit", lambda n, bits: 5)
        linked = bs.links(spark.createDataFrame([(bs.signed(v),) for v in values], "fp long")).collect()
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in linked:
            a, b = a % (1 << 64), b % (1 << 64)
            parent[find(max(a, b))] = find(min(a, b))
        of = slow_components([(v, v) for v in values])
        mine = {}
        for v in values:
            mine.setdefault(find(v), set()).add(v)
        theirs = {}
        for v in values:
            theirs.setdefault(of[v], set()).add(v)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("in_task", [1, bs.IN_TASK])
def test_components_of_long_chains(spark, monkeypatch, in_task):
    monkeypatch.setattr(bs, "IN_TASK", in_task)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    found = {r.node: r.root for r in bs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}


def test_forest_is_small():
    fps = np.arange(100, dtype=np.uint64)
    a, b = np.triu_indices(100, 1)
    assert len(bs.forest(fps, a, b)) == 99


def test_empty(frame):
    assert bs.op9(frame([])).collect() == []
