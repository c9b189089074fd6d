"""Near copies by SimHash fingerprints of five-word shingles, meet-in-the-middle balls, and verified pairs.

A bit of a fingerprint is the sign of a random projection of the text's set of shingles. With weights as uneven as can be
the heaviest shingle alone gives the sign, and texts of Jaccard similarity s differ in a bit with a probability of
(1 - s) / 2; with even weights (a majority, as in ``ball_simhash.fingerprint``) it would be acos(2 s / (1 + s)) / pi,
half as much again at s = 0.8. A text has TABLES fingerprints of BITS bits. Those of two texts of
similarity 0.8 lie within RADIUS bits in no table with a probability of 0.1 % (less above 0.8), wherever the edits lie.

In each table every fingerprint emits all its variants within half the radius, as ``ball_simhash`` does: it goes to
the buckets (leading bits) that hold variants of it, and the bucket's task makes and sorts them. Texts that
meet in a variant are candidates; the fingerprint of another table, which travels along, rules most of the chance
ones out, the bits of all tables together the rest. What is left is verified by the exact similarity of the texts'
shingles, and components are built from verified links only.

So that a group of copies costs its size and not its square, texts of equal shingles are one node, and in the first ROUNDS
rounds each node is verified against its nearest candidate of another component only. Nodes that may still have links go into families:
whoever shares a variant with a text of another component is of its family, which a forest of such meetings tells. In a family all pairs
are settled by the difference of each text from the family's center (the shingles that most have). With d the size of
this difference and w = 9 d - size, two texts are similar if and only if 18 times what their differences share is at least
the sum of their w. So all whose w is low enough are linked to the least one, without a look at pairs, and all other links
show in a shared shingle among the rarest of both differences: those alone are compared, where the components still differ and the
places allow it. No pair is left out. A family beyond IN_TASK shingles is dealt over tasks by the shingles of its differences.
Only the texts of nodes with candidates are moved.

Defined cases: words are split at white space, in lower case for ASCII; texts with fewer words than a shingle are one
shingle; null and empty texts are copies of each other; null ids sort after all others; repeated rows are copies of
each other and rows of one id but different texts are not; texts of any length are read whole; an empty table gives
an empty result; other columns of the input, whatever their names, are carried inside a struct and cannot clash.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from codefacts.llm.ball_simhash import SEED, components, emitted, flips, hot_limit
from codefacts.llm.common import BATCH_ROWS, arrow_batches, bloom, mapped, maybe_in, saved, sliced, text_of

WORDS = 5
#: Similarity from which a pair is linked: LEAST / OF.
LEAST, OF = 4, 5
#: Fingerprints, their bits, and the distance within which two meet.
TABLES, BITS, RADIUS = 15, 32, 2
#: The most differing bits of candidates, in a fingerprint of another table and in all: at a similarity of 0.8 more have a
#: probability of 0.3 % (each table has another one) and of 0.005 %.
FAR, FAR_IN_ALL = 8, 75
#: Rounds in which nodes are verified against their nearest candidates only, and how many of those that share a variant are looked at for them.
ROUNDS, LOOK = 3, 256
#: Candidates that a task holds at a time.
PAIRS = 1 << 20
#: Shingles of a family that one task holds (8 bytes each, some five times over), and texts whose center stands for that of a larger family.
IN_TASK, SAMPLE = 1 << 22, 64
#: Fingerprints that a bucket should hold of its own, and the least and the most leading bits.
BUCKET, LEAST_BITS, MOST_BITS = 1 << 16, 5, 20


def constants(n: int, name: str, kind: type = np.uint64) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}", SEED) | 1 for i in range(n)], np.uint64).astype(kind)


PLACES = constants(WORDS, "place")
TURN, TIMES, SIGN = (constants(TABLES * BITS, n, np.uint32) for n in ("turn", "times", "sign"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, sorted."""
    hashed = xxhash.xxh64_intdigest
    words = np.array([hashed(t, SEED) for t in text.encode().lower().split()], np.uint64)
    if len(words) < WORDS:
        return mixed(np.array([(words * PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))]))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += words[k : k + n] * PLACES[k]
    return np.unique(mixed(total))


def fingerprints(own: np.ndarray) -> bytes:
    """The TABLES fingerprints of a set of shingles, highest bits first: each bit is the sign of the shingle that weighs most in it."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    heaviest = np.full(TABLES * BITS, 0xFFFFFFFF, np.uint32)
    work = np.empty((128, TABLES * BITS), np.uint32)
    for at in range(0, len(x), 128):
        part = x[at : at + 128, None]
        out = work[: len(part)]
        np.bitwise_xor(part, TURN, out=out)
        np.multiply(out, TIMES, out=out)
        np.minimum(heaviest, out.min(axis=0), out=heaviest)
    sign = heaviest.astype(np.uint64) << np.uint64(32) | SIGN
    return np.packbits(mixed(sign) >> np.uint64(63) == 1).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component once a and b are linked; root: that before."""
    while True:
        low, before = np.minimum(root[a], root[b]), root
        root = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            return root


class Center:
    """The shingles that most of some texts have, and how many of these differ from it in a shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        names, times = np.unique(np.concatenate(sets), return_counts=True)
        inner = 2 * times > len(sets)
        self.shingles = names[inner]
        times[inner] = len(sets) - times[inner]
        self.names, self.often = names[times > 1], times[times > 1]

    def difference(self, own: np.ndarray) -> np.ndarray:
        """The shingles that either the text or the center has, rarest first: one order for all texts."""
        apart = np.setxor1d(own, self.shingles, assume_unique=True)
        often = np.zeros(len(apart), np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, apart), len(self.names) - 1)
            often = np.where(self.names[at] == apart, self.often[at], 0)
        return apart[np.argsort(often, kind="stable")]


def weight(difference: int | np.ndarray, size: int | np.ndarray) -> int | np.ndarray:
    """Two texts are similar where 2 (OF + LEAST) times what their differences share reaches the sum of their weights."""
    return (OF + LEAST) * difference - (OF - LEAST) * size


def needed(weights: int | np.ndarray) -> int | np.ndarray:
    """What two differences must share by the sum of their weights, where they must share anything at all."""
    return np.maximum(1, -(-weights // (2 * (OF + LEAST))))


def settled(differences: list[np.ndarray], size: np.ndarray, root: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
    """The least place of each text's component by all similar pairs that share nothing, or a shingle of this part. root: components before.

    differences: from one center and in its order.
    """
    n, length = len(differences), np.array([len(d) for d in differences], np.int64)
    w = weight(length, size)
    least = int(np.argmin(w))
    # Similar even if their differences share nothing: whoever has such a partner has it in the least one too.
    close = np.flatnonzero(w + w[least] <= 0)
    root = united(root, close, np.full(len(close), least))
    names, token, often = np.unique(np.concatenate(differences), return_inverse=True, return_counts=True)
    if not len(names):
        return root
    node, start = np.repeat(np.arange(n), length), np.cumsum(length) - length
    left = length[node] - (np.arange(len(node)) - start[node])
    key = np.sort(node * len(names) + token)
    mine = (often > 1) & (names % np.uint64(parts) == np.uint64(part))
    # Two texts share no more than what is left in both from the first shared shingle on.
    at = np.flatnonzero(mine[token] & (left >= needed(w[least] + w)[node]))
    at = at[np.lexsort((w[node[at]], token[at]))]
    of, same, left = node[at], token[at], left[at]
    ends, outer = np.searchsorted(same, same, side="right"), w[of] + w[least] > 0
    # Of one shingle's texts, by weight, each meets those that follow; the close ones come first and do not meet each other.
    first = np.maximum(np.arange(len(at)) + 1, ends - np.bincount(same, weights=outer, minlength=len(names)).astype(np.int64)[same])
    follow = np.where(left >= needed(2 * w[of]), ends - first, 0)
    total, done = np.cumsum(follow), 0
    while done < len(at):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
        many = follow[done:end]
        x = np.repeat(np.arange(done, end), many)
        y = np.repeat(first[done:end] - (np.cumsum(many) - many), many) + np.arange(len(x))
        done = end
        ok = (root[of[x]] != root[of[y]]) & (np.minimum(left[x], left[y]) >= needed(w[of[x]] + w[of[y]]))
        pairs = np.unique(np.minimum(of[x[ok]], of[y[ok]]) * n + np.maximum(of[x[ok]], of[y[ok]]))
        step = max(1, PAIRS // int(length.max()))
        for k in range(0, len(pairs), step):
            a, b = pairs[k : k + step] // n, pairs[k : k + step] % n
            some = length[a]
            own = np.repeat(start[a] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            wanted = np.repeat(b, some) * len(names) + token[own]
            there = key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted
            both = np.bincount(np.repeat(np.arange(len(a)), some), weights=there, minlength=len(a)).astype(np.int64)
            ok = 2 * (OF + LEAST) * both >= w[a] + w[b]
            root = united(root, a[ok], b[ok])
    return root


def places(root: np.ndarray) -> np.ndarray:
    """The first place of each place's component, of components by name."""
    _, first, of = np.unique(root, return_index=True, return_inverse=True)
    return first[of]


def links_of(root: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """a, b: names of components that are one now."""
    new = np.unique(before[after[before] != before])
    return pa.RecordBatch.from_arrays([pa.array(root[new]), pa.array(root[after[new]])], names=["a", "b"])


ENTRY = np.dtype([("print", "<u8"), ("node", "<i8"), ("root", "<i8"), ("size", "<i4")])


def met(entries: np.ndarray, bits: int, prefix: int, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates a, b and their distance among entries that share a variant with these leading bits. Entries of one root make no pair.

    nearest: nodes, of each the nearest one of LOOK that follow or precede it. Otherwise roots, a forest of all that meet, where all of
    more than LOOK that share a variant are taken to meet.
    """
    fps = (entries["print"] >> np.uint64(32)).astype(np.uint64)
    home = (fps >> np.uint64(BITS - bits)) == np.uint64(prefix)
    inside = np.uint64((1 << (BITS - bits)) - 1)
    masks = np.concatenate(flips(list(range(BITS - bits)), RADIUS // 2))
    near, far = np.flatnonzero(home).astype(np.uint64), np.flatnonzero(~home).astype(np.uint64)
    packed = [((((fps[near] & inside)[:, None] ^ masks[None, :]) << np.uint64(32)) | near[:, None]).ravel(), (fps[far] & inside) << np.uint64(32) | far]
    packed = np.sort(np.concatenate(packed))
    variant, place = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]])) if len(variant) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(variant)))
    # How many entries follow in the same run; runs of one are done with.
    follow = np.repeat(starts + lengths, lengths) - 1 - np.arange(len(variant))
    check, root, size = (entries["print"] & np.uint64(0xFFFFFFFF)), entries["root"], entries["size"].astype(np.int64)
    many, best = max(1, len(entries)), np.full(len(entries), np.iinfo(np.int64).max)
    names, of = np.unique(root, return_inverse=True)
    family, found, held = np.arange(len(names)), [], 0
    at = np.flatnonzero(follow > 0)
    if not nearest:
        long = np.repeat(lengths > LOOK, lengths)[at]
        family = united(family, of[place[at[long]]], of[place[at[long] + 1]])
        at = at[~long]
    for step in range(1, min(LOOK + 1, int(lengths.max(initial=1)))):
        at = at[follow[at] >= step]
        i, j = place[at], place[at + step]
        # Both sizes must allow for the similarity.
        apart = np.bitwise_count(check[i] ^ check[j]).astype(np.int64)
        ok = (root[i] != root[j]) & (apart <= FAR) & (np.minimum(size[i], size[j]) * OF >= np.maximum(size[i], size[j]) * LEAST)
        i, j, apart = i[ok], j[ok], apart[ok]
        if not len(i):
            continue
        if nearest:
            apart += np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64)
            np.minimum.at(best, i, apart * many + j)
            np.minimum.at(best, j, apart * many + i)
        else:
            found.append((of[i], of[j]))
            held += len(i)
            if held > PAIRS:
                family, found, held = united(family, *map(np.concatenate, zip(*found, strict=True))), [], 0
    if not nearest:
        if found:
            family = united(family, *map(np.concatenate, zip(*found, strict=True)))
        a = np.flatnonzero(family != np.arange(len(names)))
        return names[a], names[family[a]], np.zeros(len(a), np.int64)
    # Where a run is too long to be looked through, its entries stay in question: they name themselves.
    none = np.iinfo(np.int64).max
    more = np.unique(place[np.repeat(lengths > LOOK, lengths)])
    more = more[best[more] == none]
    best[more] = BITS * 2 * many + more
    a = np.flatnonzero(best < none)
    return entries["node"][a], entries["node"][best[a] % many], best[a] // many


def candidates(nodes: DataFrame, turn: int, nearest: bool) -> DataFrame:
    """a, b: pairs of nodes of different roots that meet, or else of roots, a forest. nodes: node, root, size, prints (all fingerprints); turn: which table rules chance meetings out."""
    n = nodes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1, n) / BUCKET))))
    limit = max(4 * BUCKET, hot_limit(n, bits))
    head = lambda k: F.conv(F.hex(F.substring("prints", 4 * k + 1, 4)), 16, 10).cast("long")
    of_table = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(head(k), BITS - bits).alias("bucket")) for k in range(TABLES)])).alias("x")
    # At most n / limit buckets of a table can be hot.
    heavy = nodes.select(of_table).groupBy("x.k", "x.bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()
    hot: list[dict[int, int]] = [{} for _ in range(TABLES)]
    for r in heavy:
        hot[r["k"]][r["bucket"]] = min(BITS - bits, 12, math.ceil(math.log2(r["n"] / limit)) + 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), ">u4").reshape(-1, TABLES).astype(np.uint64)
            entries = np.empty(batch.num_rows, ENTRY)
            for name in ("node", "root", "size"):
                entries[name] = batch.column(name).to_numpy()
            for k in range(TABLES):
                entries["print"] = prints[:, k] << np.uint64(32) | prints[:, (k + 1 + turn) % TABLES]
                rows: dict[tuple[int, int], list[bytes]] = {}
                for b, p, at in emitted(entries["print"], bits, hot[k], RADIUS // 2):
                    rows.setdefault((b, p), []).append(entries[at].tobytes())
                keys = list(rows)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(keys), pa.int32()), pa.array([x[0] for x in keys], pa.int32()), pa.array([x[1] for x in keys], pa.int32()), pa.array([b"".join(rows[x]) for x in keys], pa.binary())], names=["k", "bucket", "part", "entries"])

    def meet(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, bucket, part = (x.as_py() for x in key)
        more = hot[k].get(bucket, 0)
        entries = np.frombuffer(b"".join(e for batch in group for e in batch.column("entries").to_pylist()), ENTRY)
        a, b, apart = met(entries, bits + more, bucket << more | part, nearest)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32))], names=["a", "b", "apart"])

    with arrow_batches(nodes.sparkSession, 32768):
        sent = nodes.select("node", "root", "size", "prints").repartition(max(4, min(n >> 13, 4096))).mapInArrow(emit, "k int, bucket int, part int, entries binary")
        pairs = sent.groupBy("k", "bucket", "part").applyInArrow(meet, "a long, b long, apart int")
        if nearest:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", "x.b")
        return saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose fingerprints of all tables together allow for the similarity."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("prints").alias(f"prints_{c}")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("prints_a", "prints_b"))
            yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1) <= FAR_IN_ALL))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "prints_a", "prints_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of nodes whose texts are similar. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = shingles(text)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[node]

        for batch in sliced(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([similar(of(a, ta), of(b, tb)) for a, b, ta, tb in rows], pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    with arrow_batches(pairs.sparkSession, BATCH_ROWS):
        return saved(joined.mapInArrow(run, "a long, b long"), "verified")


def in_families(texts: DataFrame) -> DataFrame:
    """a, b: components of which texts are similar, enough of them for all such links. texts: family, root, node, text."""

    def alone(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, sets = [], []
        for batch in group:
            root.append(batch.column("root").to_numpy())
            sets += [shingles(t) for t in batch.column("text").to_pylist()]
        root, center = np.concatenate(root), Center(sets)
        before = places(root)
        yield links_of(root, before, settled([center.difference(s) for s in sets], np.array([len(s) for s in sets]), before))

    with arrow_batches(texts.sparkSession, BATCH_ROWS):
        return saved(texts.select("family", "root", "text").groupBy("family").applyInArrow(alone, "a long, b long"), "linked")


def in_parts(texts: DataFrame, centers: DataFrame) -> DataFrame:
    """The same for families beyond IN_TASK. centers: family, text, of some texts."""
    spark = texts.sparkSession

    def center(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = Center([shingles(t) for t in group.column("text").to_pylist()])
        return pa.table({"family": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([getattr(found, k).tobytes()], pa.binary()) for k in ("shingles", "names", "often")})

    def of(r: Row) -> Center:
        made = Center.__new__(Center)
        made.shingles, made.names, made.often = np.frombuffer(r.shingles, np.uint64), np.frombuffer(r.names, np.uint64), np.frombuffer(r.often, np.int64)
        return made

    # Some kilobytes for each family beyond IN_TASK.
    known = {r.family: of(r) for r in centers.groupBy("family").applyInArrow(center, "family long, shingles binary, names binary, often binary").collect()}

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            apart = [known[f].difference(s) for f, s in zip(batch.column("family").to_pylist(), sets, strict=True)]
            columns = [[len(s) for s in sets], [len(d) for d in apart], [weight(len(d), len(s)) for d, s in zip(apart, sets, strict=True)]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "root", "node")), *(pa.array(c, pa.int64()) for c in columns), pa.array([d.tobytes() for d in apart], pa.binary())], names=["family", "root", "node", "size", "length", "w", "apart"])

    with arrow_batches(spark, BATCH_ROWS):
        apart = saved(texts.select("family", "root", "node", "text").mapInArrow(differ, "family long, root long, node long, size long, length long, w long, apart binary"), "apart")
    least = {r.family: r for r in apart.groupBy("family").agg(F.min(F.struct("w", "root")).alias("x"), F.sum(F.col("length") * F.col("length")).alias("n")).collect()}
    parts = {f: max(1, math.ceil(r.n / IN_TASK)) for f, r in least.items()}
    lowest = {f: (r.x.w, r.x.root) for f, r in least.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, w = batch.column("family").to_pylist(), batch.column("w").to_pylist()
            close = pa.array([x + lowest[f][0] <= 0 for f, x in zip(family, w, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array([lowest[f][1] for f in family], pa.int64())], names=["a", "b"]).filter(close)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 32):
            at, part = [], []
            for i, (f, w, d) in enumerate(zip(batch.column("family").to_pylist(), batch.column("w").to_pylist(), batch.column("apart").to_pylist(), strict=True)):
                d = np.frombuffer(d, np.uint64)
                own = np.unique(d[: max(0, len(d) - int(needed(lowest[f][0] + w)) + 1)] % np.uint64(parts[f])).tolist()
                at += [i] * len(own)
                part += own
            out = batch.select(["family", "root", "size", "apart"]).take(pa.array(at, pa.int32()))
            yield out.append_column("part", pa.array(part, pa.int64()))

    def unite(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, part = (x.as_py() for x in key)
        root, size, apart = [], [], []
        for batch in group:
            root.append(batch.column("root").to_numpy())
            size.append(batch.column("size").to_numpy())
            apart += [np.frombuffer(d, np.uint64) for d in batch.column("apart").to_pylist()]
        root = np.concatenate(root)
        before = places(root)
        yield links_of(root, before, settled(apart, np.concatenate(size), before, part, parts[family]))

    closest = saved(apart.select("family", "root", "w").mapInArrow(near, "a long, b long").where("a <> b").distinct(), "closest")
    with arrow_batches(spark, BATCH_ROWS):
        dealt = apart.select("family", "root", "size", "w", "apart").mapInArrow(deal, "family long, root long, size long, apart binary, part long")
        return closest.unionByName(saved(dealt.groupBy("family", "part").applyInArrow(unite, "a long, b long"), "linked"))


def with_roots(of: DataFrame) -> DataFrame:
    """node, root: the roots too."""
    return of.unionByName(of.select(F.col("root").alias("node"), "root").distinct())


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """node, root with the links a, b added."""
    if found.isEmpty():
        return roots
    return saved(with_roots(components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))), "roots")


class Copies:
    """The near copies of a table: rows (row, tag) and, of all rows with copies, their group."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.rows = saved(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("tag")), "rows", compression="zstd")
        self.id, self.text = F.col(f"row.{id_col}"), text_of(f"row.{text_col}")

        def make():
            def work(tags, texts):
                own = [shingles(t) for t in texts]
                return [[xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in own], [len(s) for s in own], [fingerprints(s) for s in own]]

            return work

        profiles = mapped(self.rows.select("tag", self.text.alias("text")), make, "own binary, size int, prints binary")
        nodes = profiles.groupBy("own").agg(F.min(F.struct("tag", "size", "prints")).alias("x"), F.count(F.lit(1)).alias("n"))
        self.nodes = saved(nodes.select("own", "n", F.col("x.tag").alias("node"), "x.size", "x.prints"), "nodes")
        several = self.nodes.where("n > 1").select(F.col("own").alias("name"), "node")
        self.equal = saved(profiles.select("tag", "own").join(several.hint("merge"), F.col("own") == F.col("name")).select("tag", "node"), "equal")
        self.members = saved(self.grouped(), "members")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """node and text of some nodes; other rows may pass where the filter lets them, and meet no pair."""
        own = self.rows.select("tag", self.text.alias("text"))
        return saved(maybe_in(own, "tag", bloom(wanted, "node")).where("maybe").select(F.col("tag").alias("node"), "text"), "texts", compression="zstd")

    def linked(self) -> DataFrame:
        """node, root: the nodes that have links, with the least node of their component."""
        rest = self.nodes.select("node", F.col("node").alias("root"), "size", "prints")
        seen, roots = None, saved(rest.select("node", "root").limit(0), "roots")
        for turn in range(ROUNDS):
            met = candidates(rest, turn, True)
            if met.isEmpty():
                return roots
            pairs = met.where("a <> b")
            pairs = saved(close(pairs if seen is None else pairs.join(seen.hint("merge"), ["a", "b"], "left_anti"), rest), "close")
            found = verified(pairs, self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
            seen = pairs if seen is None else seen.unionByName(pairs)
            roots = joined(roots, found)
            # Who met nobody of another component now will not later.
            restless = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            rest = rest.drop("root").join(restless.hint("merge"), "node", "left_semi").join(roots.hint("merge"), "node", "left")
            rest = saved(rest.select("node", F.coalesce("root", "node").alias("root"), "size", "prints"), "rest")
        met = candidates(rest, ROUNDS, False)
        if met.isEmpty():
            return roots
        of = with_roots(components(met)).select(F.col("node").alias("root"), F.col("root").alias("family"))
        rest = saved(rest.select("node", "root", "size").join(of.hint("merge"), "root").select("node", "root", "family", "size"), "families")
        texts = rest.join(self.texts(rest.select("node")).hint("merge"), "node")
        # Few: each holds more than IN_TASK shingles.
        large = [r.family for r in rest.groupBy("family").agg(F.sum("size").alias("n")).where(F.col("n") > IN_TASK).collect()]
        found = in_families(texts.where(~F.col("family").isin(large)))
        if large:
            by_hash = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
            some = rest.where(F.col("family").isin(large)).withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= SAMPLE).select("node")
            texts = saved(texts.where(F.col("family").isin(large)), "large", compression="zstd")
            found = found.unionByName(in_parts(texts, texts.join(some.hint("merge"), "node", "left_semi").select("family", "text")))
        return joined(roots, found)

    def grouped(self) -> DataFrame:
        """tag, doc_id, root, keep_id, kept: the rows that have copies, and the smallest id of their group."""
        roots = self.linked()
        equal = self.equal.join(roots.hint("merge"), "node", "left").select("tag", F.coalesce("root", "node").alias("root"))
        alone = roots.select(F.col("node").alias("tag"), "root").join(self.equal.hint("merge"), "tag", "left_anti")
        ids = self.rows.select(F.col("tag").alias("of"), self.id.alias("doc_id"))
        members = saved(equal.unionByName(alone).join(ids.hint("merge"), F.col("tag") == F.col("of")).select("tag", "root", "doc_id"), "grouped")
        best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("tag"))).alias("best"))
        named = members.join(best.hint("merge"), "root")
        return named.select("tag", "doc_id", "root", F.col("best.doc_id").alias("keep_id"), (F.col("tag") == F.col("best.tag")).alias("kept"))

    def kept_rows(self) -> DataFrame:
        """The rows that stay, with their columns as they were: of each group that with the smallest id."""
        dropped = saved(self.members.where("not kept").select("tag"), "dropped")
        probed = maybe_in(self.rows, "tag", bloom(dropped, "tag"))
        some = probed.where("maybe").select("row", "tag").join(dropped.hint("merge"), "tag", "left_anti")
        return probed.where("not maybe").select("row.*").unionByName(some.select("row.*"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with its columns as it was."""
    return Copies(docs).kept_rows()
