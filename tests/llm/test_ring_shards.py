import random
import zlib
from collections import Counter

from codefacts.llm import ring_shards


def test_walk_is_the_sequential_insertion():
    rng = random.Random(1)
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(ring_shards.CELLS), 300)}
    nodes = ring_shards.ring(8)
    room = ring_shards.capacities(sum(counts.values()), 8)
    expected = []
    for cell in sorted(counts):
        for rank in range(counts[cell]):
            at = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
            while not room[nodes[at % len(nodes)][1]]:
                at += 1
            shard = nodes[at % len(nodes)][1]
            room[shard] -= 1
            expected.append((cell, rank, shard))
    runs = ring_shards.walk(counts, 8)
    found = []
    for cell in sorted(counts):
        own = [r for r in runs if r[0] == cell]
        for rank in range(counts[cell]):
            found.append((cell, rank, [r for r in own if r[1] <= rank][-1][2]))
    assert found == expected
    assert not any(room)


def test_rows_law_and_slots(frame, odd_rows):
    found = ring_shards.op2(frame(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    per = Counter(r.shard for r in found)
    assert set(per) <= set(range(8)) and max(per.values()) - min(per.get(s, 0) for s in range(8)) <= 1
    for s in per:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(per[s]))
    expected = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == expected
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}


def test_few_rows_move_when_a_shard_is_added(frame):
    docs = frame([(i, f"text {i}") for i in range(2000)])
    at = lambda n, slack: {r.doc_id: r.shard for r in ring_shards.shard(docs, n, slack).collect()}
    a, b = at(8, 0.25), at(9, 0.25)
    assert max(Counter(a.values()).values()) <= -(-2000 * 1.25 // 8)
    assert sum(a[i] != b[i] for i in a) < 0.45 * 2000


def test_empty_table(frame):
    assert ring_shards.op2(frame([])).collect() == []


def test_the_whole_query_against_insertion_one_by_one(spark, frame, odd_rows):
    rows = odd_rows + [(i, f"text {i % 50}") for i in range(1000, 1400)]
    keyed = spark.createDataFrame([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows], "doc_id long, size long, crc long")
    places = keyed.selectExpr("doc_id", "size", "crc", "xxhash64(doc_id, crc) AS place").collect()
    # Ring order: by the 64-bit place, read as unsigned.
    ring = sorted(places, key=lambda r: (r.place % (1 << 64) >> 50, r.place, r.doc_id is not None, r.doc_id or 0, r["size"]))
    nodes, room, filled, expected = ring_shards.ring(8), [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)], [0] * 8, []
    for r in ring:
        cell = r.place % (1 << 64) >> 50
        at = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        while filled[nodes[at % len(nodes)][1]] == room[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        expected.append((r.doc_id, r["size"], r.crc, shard, filled[shard]))
        filled[shard] += 1
    found = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in ring_shards.op2(frame(rows)).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_a_hot_cell_is_ranked_in_parts(frame, monkeypatch):
    monkeypatch.setattr(ring_shards, "LEAST_HOT", 10)
    rows = [(None, "the same")] * 400 + [(i, f"text {i}") for i in range(400)]
    found = ring_shards.op2(frame(rows).repartition(5)).collect()
    per = Counter(r.shard for r in found)
    assert per == {s: 100 for s in range(8)}
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(100)) for s in range(8))
