"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 2r bits have a common variant within r bits of both. Each
distinct fingerprint therefore emits all its variants within r; variants are shuffled, and
fingerprints that meet in one are verified by their distance.

The 1 + 64 + 2016 variants of a fingerprint (r = 2) are not shuffled one by one. A variant's bucket is
its leading bits; of the flips of a fingerprint only those inside the leading bits change the bucket,
so a fingerprint goes once to each bucket that holds variants of its (79 of 4096), and the bucket's task
makes the variants that lie there, sorts them and reads off the meetings. The number of leading bits
grows with the number of fingerprints, so that a bucket's load does not, up to MOST_BITS and, in buckets whose load is
many times the mean, 12 further bits by which these are split in the same way; beyond some 10^8 distinct fingerprints buckets grow
with the input.

All fingerprints that share a variant are within 2r of each other, so neighbours in the sorted order
suffice: no group is expanded into its pairs. Each task reduces its links to a forest, links
of all tasks are merged by alternating star contractions (a few shuffles of links, written to the shared
folder after each round), and copies of one fingerprint are one node throughout.

Defined cases: null and empty texts have fingerprint zero, which links like any other; texts with fewer
words than a shingle hash as one shingle; rows without an id get their fingerprint and component but
name no component unless it has no id at all; repeated rows get equal rows; texts of any length are read whole; other
columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import arrow_batches, mapped, saved

SEED, WORDS, RADIUS = 42, 4, 4
#: Fingerprints that a bucket should hold of its own, and the most leading bits.
BUCKET, MOST_BITS = 64, 20
#: Links that one task unites: 16 bytes each.
IN_TASK = 1 << 20
#: A bucket is split when it receives so many times the mean.
HOT = 8


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = (starts, ends[-1:]) if len(tokens) < words else (starts[: len(tokens) - words + 1], ends[words - 1 :])
    hashed, n, votes = xxhash.xxh64_intdigest, len(last), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hashed(line[a:b], seed) for a, b in zip(first[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist())], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number)."""
    out = mapped(docs.select(id_col, text_col), lambda: lambda ids, texts: [[signed(fingerprint(t, words)) for t in texts]], "fp long")
    return out.withColumnRenamed(id_col, "doc_id")


def flips(bits: list[int], most: int) -> list[np.ndarray]:
    """For each number of flips up to most: the masks over the given bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(bits, n)], dtype=np.uint64) for n in range(most + 1)]


def emitted(fps: np.ndarray, bits: int, split: dict[int, int], radius: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, part, places): where variants of these fingerprints lie. split: further bits of hot buckets."""
    home = (fps >> np.uint64(64 - bits)).astype(np.int64)
    for near, masks in enumerate(flips(list(range(bits)), radius)):
        for mask in masks.tolist():
            bucket = home ^ mask
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for chunk in np.split(order, cuts):
                b = int(bucket[chunk[0]])
                if not (more := split.get(b, 0)):
                    yield b, 0, chunk
                    continue
                own = (fps[chunk] >> np.uint64(64 - bits - more)).astype(np.int64) & ((1 << more) - 1)
                for extra in flips(list(range(more)), radius - near):
                    for x in extra.tolist():
                        part = own ^ x
                        for p in np.unique(part):
                            yield b, int(p), chunk[part == p]


def met(fps: np.ndarray, bits: int, prefix: int, radius: int, twice: int) -> np.ndarray:
    """Links (pairs) among the fingerprints that share a variant whose leading bits are the prefix; as a forest.

    Variants are packed with their fingerprint's place into one number and sorted; a hash in
    the leading part stands for the variant, so neighbours are verified by their distance.
    """
    fps = np.unique(fps)
    room = max(1, int(len(fps) - 1).bit_length())
    low, keep = flips(list(range(64 - bits)), radius), np.uint64((1 << room) - 1)
    away = np.bitwise_count((fps >> np.uint64(64 - bits)) ^ np.uint64(prefix))
    packed = []
    inside = np.uint64((1 << (64 - bits)) - 1)
    for near in range(radius + 1):
        places = np.flatnonzero(away == near).astype(np.uint64)
        if len(places):
            masks = np.concatenate(low[: radius - near + 1])
            variants = (fps[places] & inside)[:, None] ^ masks[None, :]
            variants *= np.uint64(0x9E3779B97F4A7C15)
            variants ^= variants >> np.uint64(29)
            variants *= np.uint64(0xBF58476D1CE4E5B9)
            variants &= ~keep
            variants |= places[:, None]
            packed.append(variants.ravel())
    if not packed:
        return np.empty((0, 2), np.uint64)
    packed = np.concatenate(packed)
    packed.sort()
    same = np.flatnonzero((packed[1:] ^ packed[:-1]) <= keep)
    a, b = (packed[same] & keep).astype(np.int64), (packed[same + 1] & keep).astype(np.int64)
    pairs = np.unique(a * len(fps) + b)
    a, b = pairs // len(fps), pairs % len(fps)
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= twice)
    return forest(fps, a[near], b[near])


def forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each linked node with the smallest node of its component."""
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            linked = np.flatnonzero(root != np.arange(len(fps)))
            return np.stack([fps[linked], fps[root[linked]]], axis=1) if len(linked) else np.empty((0, 2), fps.dtype)


def hot_limit(n: int, bits: int) -> int:
    """Fingerprints of its own beyond which a bucket is split; a multiple of the mean."""
    return max(4 * HOT * BUCKET, HOT * n >> bits)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b (signed fingerprints) whose components are those of all pairs within the radius. distinct: column fp."""
    half, n = radius // 2, distinct.count()
    bits = min(MOST_BITS, max(4, round(math.log2(max(1, n) / BUCKET))))
    home = F.shiftrightunsigned("fp", 64 - bits).alias("bucket")
    limit = hot_limit(n, bits)
    # At most n / limit <= 2 ** bits / HOT buckets can be hot.
    hot = {r["bucket"]: min(12, math.ceil(math.log2(r["n"] / limit)) + 2) for r in distinct.groupBy(home).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 1 << 15):
                rows: dict[tuple[int, int], list[bytes]] = {}
                some = fps[at : at + (1 << 15)]
                for b, p, own in emitted(some, bits, hot, half):
                    rows.setdefault((b, p), []).append(some[own].tobytes())
                keys = list(rows)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([b"".join(rows[k]) for k in keys], pa.binary())], names=["bucket", "part", "fps"])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bucket, part = key[0].as_py(), key[1].as_py()
        more = hot.get(bucket, 0)
        found = met(np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64), bits + more, bucket << more | part, half, radius).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    with arrow_batches(distinct.sparkSession, 32768):
        sent = distinct.repartition(max(4, min(n >> 13, 4096))).mapInArrow(emit, "bucket int, part int, fps binary")
        return saved(sent.groupBy("bucket", "part").applyInArrow(meet, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of every linked node but the roots. edges: a, b (whole numbers).

    Up to IN_TASK distinct links are united inside one task; more go round by round, by alternating large-star and
    small-star contractions.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = saved(edges, "links")
    if edges.count() <= IN_TASK:

        def unite(key: tuple, group: pa.Table) -> pa.Table:
            nodes, at = np.unique(np.concatenate([group.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
            found = forest(nodes, at[: len(group)], at[len(group) :])
            return pa.table({"node": found[:, 0], "root": found[:, 1]})

        return edges.groupBy(F.lit(0).alias("all")).applyInArrow(unite, "node long, root long")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = saved(edges, "stars")
        # Small star: every smaller neighbour of u, and u itself, goes to the least of them.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = fingerprints(docs, words, id_col, text_col)
    # A fingerprint's least id goes along; copies of one fingerprint are one node.
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    labelled = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    # Written first: a join of its own shuffle is one that AQE splits where a component is large.
    named = saved(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = saved(labelled.join(named, "root").select("fp", "component_id"), "named")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
