"""Set and sequence similarity on token tables; no knowledge of programs or languages."""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.storage import saved

WINDOW = 50


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` numbers: their sum with one odd factor for each place."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out, h = np.zeros(n, np.uint64), np.asarray(hashes, np.int64).view(np.uint64)
    for j in range(width):
        out += h[j : j + n] * FACTORS[j]
    return out.view(np.int64)


#: Odd factors by place, from one multiplier.
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(1024)]


def rolled_each(rows: list[np.ndarray], width: int) -> list[np.ndarray]:
    """``rolled`` of each row; many rows are summed at once."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(rows):
        stop, n = at + 1, len(rows[at])
        while stop < len(rows) and n < 1 << 18:
            n, stop = n + len(rows[stop]), stop + 1
        whole, start = rolled(np.concatenate(rows[at:stop]), width), 0
        for r in rows[at:stop]:
            out.append(whole[start : start + max(0, len(r) - width + 1)])
            start += len(r)
        at = stop
    return out


class Hashed(dict):
    """Tokens (bytes) to 64-bit hashes, the same in every worker; those seen before are looked up."""

    MOST = 1 << 20

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[token] = int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little", signed=True)
        return found


def text_windows(text: str | Column, separators: str, width: int = WINDOW) -> Column:
    """Hashes of all runs of ``width`` consecutive tokens of a text, step one; tokens lie between separators (ASCII, a space among them). Null has none."""
    spaces = bytes.maketrans(separators.encode(), b" " * len(separators))

    @F.pandas_udf("array<long>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Hashed()
        for texts in batches:
            tokens = ((t or "").encode().translate(spaces).split(b" ") for t in texts)
            yield pd.Series(rolled_each([np.array([known[w] for w in t if w], np.int64) for t in tokens], width), dtype=object)

    return runs(F.col(text) if isinstance(text, str) else text)


def windows(tokens: str | Column, width: int = WINDOW) -> Column:
    """Hashes of all runs of ``width`` consecutive tokens, step one; none if there are fewer tokens.

    Tokens are hashed by Spark; the runs of a batch's rows are summed in Python, each token touched
    ``width`` times as a number and not as text.
    """

    @F.pandas_udf("array<long>")
    def runs(rows: pd.Series) -> pd.Series:
        return pd.Series([rolled(r, width) if r is not None else [] for r in rows])

    return runs(F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: F.xxhash64(t)))


def once(value: Column) -> Column:
    """The value as the output of a generator: it is computed once, however often later columns use it."""
    return F.explode(F.array(value))


def profiles(items: DataFrame, key: Sequence[str], shape: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct multiset of windows: profile, shape, windows, members (keys) and total.

    items: key, shape and windows (an array). Items with equal windows and shape share a
    profile, so that a group of copies costs the pair join one row.
    """
    own = items.where(F.size("windows") > 0).select(F.struct(*key).alias("key"), *shape, F.sort_array("windows").alias("windows"))
    return own.groupBy(*shape, "windows").agg(F.min("key").alias("profile"), F.count(F.lit(1)).alias("members"), F.size(F.first("windows")).alias("total"))


def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of two sorted arrays, row by row."""

    def size(x: np.ndarray, y: np.ndarray) -> int:
        (ux, nx), (uy, ny) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        return int(np.minimum(nx[i], ny[j]).sum())

    return pd.Series([size(x, y) for x, y in zip(a, b)], dtype="int64")


#: A window of a profile; in how many profiles it is, or (as an entry of a prefix) nothing.
ENTRY = np.dtype([("window", "<u8"), ("tag", "<i8"), ("total", "<i4"), ("distinct", "<i4"), ("many", "<i8")])
#: Entries that one task holds at a time, of those that it receives, and pairs.
HELD, PAIRS = 1 << 20, 1 << 20


def blobs(entries: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its entries as bytes."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([x.tobytes() for x in np.split(entries, starts[1:])] if len(starts) else [], pa.binary())], names=["bucket", "entries"])


def opened(group: Iterator[pa.RecordBatch]) -> np.ndarray:
    return np.frombuffer(b"".join([e for batch in group for e in batch.column("entries").to_pylist()]), ENTRY)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def candidates(own: DataFrame, least: float) -> DataFrame:
    """a, b (tags, a < b): profiles that share one of their rarest windows. own: tag, total, mark (of the shape), windows.

    Windows go to buckets as packed numbers: to be counted, back to their profiles, which take their rarest ones, and
    to their buckets again, where those that share one meet. A bucket holds some HELD entries, or those of one window.
    """
    size = own.agg(F.sum("total")).first()[0] or 0
    many = max(1, min(1 << 16, -(-size // HELD)))

    def bucket_of(windows: np.ndarray) -> np.ndarray:
        return ((windows * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(many)).astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for tag, total, mark, windows in zip(*(batch.column(c).to_pylist() for c in ("tag", "total", "mark")), batch.column("windows")):
                own_windows = np.unique(windows.values.to_numpy())
                entries = np.empty(len(own_windows), ENTRY)
                entries["window"], entries["tag"], entries["total"], entries["distinct"], entries["many"] = own_windows.view(np.uint64) ^ np.uint64(mark % (1 << 64)), tag, total, len(own_windows), 0
                held.append(entries)
                n += len(entries)
                if n > HELD // 2:
                    whole = np.concatenate(held)
                    yield blobs(whole, bucket_of(whole["window"]))
                    held, n = [], 0
        if held:
            whole = np.concatenate(held)
            yield blobs(whole, bucket_of(whole["window"]))

    def counted(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Windows of one profile alone are its rarest, and meet no other.
        entries = opened(group)
        entries = entries[np.argsort(entries["window"])]
        _, lengths = runs_of(entries["window"])
        n = np.repeat(lengths, lengths)
        entries, n = entries[n > 1], n[n > 1]
        entries["many"] = n
        yield blobs(entries, ((entries["tag"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(many)).astype(np.int32))

    def prefixes(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = opened(group)
        entries = entries[np.lexsort((entries["window"], entries["many"], entries["tag"]))]
        starts, lengths = runs_of(entries["tag"])
        place = np.arange(len(entries)) - np.repeat(starts, lengths) + 1
        total = entries["total"].astype(np.int64)
        prefix = total - np.ceil(total * least - 1e-9).astype(np.int64) + 1 - (entries["distinct"] - np.repeat(lengths, lengths))
        rare = entries[place <= prefix]
        yield blobs(rare, bucket_of(rare["window"]))

    def meet(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = opened(group)
        entries = entries[np.lexsort((entries["total"], entries["window"]))]
        total, tags = entries["total"].astype(np.int64), entries["tag"]
        starts, lengths = runs_of(entries["window"])
        follow = np.repeat(starts + lengths, lengths) - 1 - np.arange(len(entries))
        at, found, held = np.flatnonzero(follow > 0), [], 0
        for step in range(1, int(lengths.max(initial=1))):
            # Totals rise inside a run: who is too far from this one is too far from all that follow.
            at = at[follow[at] >= step]
            at = at[total[at] >= least * total[at + step]]
            if not len(at):
                break
            found.append(np.stack([np.minimum(tags[at], tags[at + step]), np.maximum(tags[at], tags[at + step])], axis=1))
            held += len(at)
            if held > PAIRS:
                yield pairs_of(found)
                found, held = [], 0
        if found:
            yield pairs_of(found)

    def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    packed = "bucket int, entries binary"
    first = own.select("tag", "total", "mark", "windows").mapInArrow(spread, packed)
    common = saved(first.groupBy("bucket").applyInArrow(counted, packed), "common")
    rare = saved(common.groupBy("bucket").applyInArrow(prefixes, packed), "rarest")
    return saved(rare.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "pairs")


def overlaps(groups: DataFrame, shape: Sequence[str] = (), least: float = 0.7) -> DataFrame:
    """a, b (profiles, a < b) and confidence: the multiset intersection over the larger total.

    Only profiles that share one of their rarest windows are compared. A profile of t windows that reaches the least
    share with another has its rarest common one among its t - least * t + 1 rarest, whichever windows these are, so that
    no pair is lost; windows that many profiles have come last and hardly ever meet. Candidates are compared on
    their whole arrays.
    """
    kind = F.struct(*shape) if shape else F.lit(0)
    own = groups.select("profile", "total", kind.alias("kind"), "windows", F.monotonically_increasing_id().alias("tag"))
    own = saved(own.withColumn("mark", F.xxhash64("kind")), "profiles")
    pairs = candidates(own, least)
    # Profiles with candidates only are moved.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("tag")).distinct()
    some = saved(own.join(wanted.hint("merge"), "tag", "left_semi").select("tag", "profile", "total", "kind", "windows"), "some")
    side = lambda c: some.select(F.col("tag").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("profile", "total", "kind", "windows")])
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where("kind_a <=> kind_b")
    size = F.pandas_udf(shared, "long")("windows_a", "windows_b")
    sized = both.select("profile_a", "profile_b", "total_a", "total_b", size.alias("shared"))
    confidence = F.col("shared") / F.greatest("total_a", "total_b")
    ordered = [f(F.col("profile_a"), F.col("profile_b")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return sized.withColumn("confidence", confidence).where(F.col("confidence") >= least).select(*ordered, "confidence")


def equal_pairs(items: DataFrame, order: Sequence[str], equal: Sequence[str], apart: Column | None = None) -> DataFrame:
    """Pairs a, b (structs of all columns) of items with equal ``equal`` columns, a before b in ``order``.

    An equi join that makes as many rows as there are pairs, as the report names pairs; apart: a condition on a and b. For groups of
    many members use ``equal_classes``, whose result grows with the items alone.
    """
    both = items.select(F.struct(*order).alias("at"), *equal, F.struct("*").alias("item"))
    left = both.select(*equal, F.col("at").alias("at_a"), F.col("item").alias("a"))
    right = both.select(*equal, F.col("at").alias("at_b"), F.col("item").alias("b"))
    pairs = left.join(right, list(equal)).where("at_a < at_b")
    return (pairs if apart is None else pairs.where(apart)).select("a", "b")


def equal_classes(items: DataFrame, order: Sequence[str], equal: Sequence[str]) -> DataFrame:
    """The items with ``first`` (the ``order`` columns of the first of their equals) and ``members`` (how many they are)."""
    classes = items.groupBy(*equal).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("members"))
    return items.join(classes, list(equal))
