"""Best-fit packing of token sequences by hierarchical residuals.

Pieces are dealt to partitions in turn, so that each one sees the whole mix of lengths. A partition packs its
own pieces, largest first, each into the open bin with the smallest
residual that holds it. Bins too full for any piece of the whole table are emitted. The underfull
ones go up a tree as items: FAN_IN nodes merge into one, which packs the bins of its children into
each other by best fit again, until one node is left. A node passes CARRY underfull bins upward at
most, those with the most room, so that no task holds more than FAN_IN * CARRY bins, whatever the input. Where
bins were passed over, a last round packs all underfull ones by their fills: bins of one fill are alike, so that a
count for each fill (LENGTH at most) is all that best fit needs; each bin then finds its sequence by its rank in its fill.

Only ids, lengths and checksums move between tasks, never texts or tokens; each round is written to
the shared folder, so that a lost executor repeats one round's part at most.

Tokens are those of the `tokenizers` library on the given file. Texts are cut into chunks at places
that no pre-token crosses; chunks seen before are looked up, others are merged by the file's own
ranks. Texts with anything unusual (added tokens, letters outside the first blocks, runs of
white space) go through the library itself.

Defined cases: null and empty texts are one piece of length 1 (the end token); texts of any length
are cut; null ids keep their rows; repeated rows are packed each; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import BATCH_ROWS, arrow_batches, arrow_schema, saved, sliced

#: Length of a sequence, children of a tree node, underfull bins that a node passes upward at most.
LENGTH, FAN_IN, CARRY = 2048, 16, 256
#: Pieces of a partition.
PART = 50_000

#: The pre-tokens of byte-level BPE: a fixed value of the tokenizer file's format.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters by which a tokenizer file writes bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    CHUNKS, LONGEST = 300_000, 40
    #: White space that stays in a chunk, and letters past the blocks whose classes never changed.
    UNUSUAL = regex.compile(r"[ \t-\r\x1c-\x1f\x85\xa0]\s|\s\Z|[^\x00-ɏ‐-‧‰-⁞]")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, self.added = byte_alphabet(), [a["content"] for a in spec["added_tokens"]]
        ranks = {bytes([alphabet[c] for c in token]): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.UNUSUAL.search(text) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        cache = self.cache
        try:
            return self.chunk(first) + b"".join([cache[w] for w in rest])
        except KeyError:
            return self.chunk(first) + b"".join([cache.get(w) or self.chunk(" " + w, w) for w in rest])

    def chunk(self, text: str, key: str | None = None) -> bytes:
        found = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        if key is not None and len(key) <= self.LONGEST:
            if len(self.cache) >= self.CHUNKS:
                self.cache.clear()
            self.cache[key] = found
        return found


def pieces(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and its end token; a shorter piece comes first."""
    n = len(ids) // 4
    cuts = [0, *range(n % length or length, n + 1, length)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def best_fit(lengths: Iterable[int], length: int = LENGTH) -> list[list[int]]:
    """Places of the items by bin: items largest first, each into the bin with the least room that holds it.

    Bins are kept by residual, and the residuals in use are the bits of one number.
    """
    lengths = list(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    used = 0
    for i in order:
        n = lengths[i]
        if fits := used >> n:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            bins[at].append(i)
            if not by_room[room]:
                used ^= 1 << room
        else:
            room, at = length, len(bins)
            bins.append([i])
        if room - n:
            by_room[room - n].append(at)
            used |= 1 << (room - n)
    return bins


BIN = "node long, fill int, open boolean, members array<struct<doc_id: {id}, piece: int, start: long, length: int, crc: long>>"


def emit(bins: list[list], fills: list[int], node: int, least: int, length: int) -> Iterator[tuple[int, int, bool, list]]:
    """Bins as rows: open are those that some piece still fits into, the CARRY with the most room."""
    order = sorted(range(len(bins)), key=lambda i: fills[i])
    for k, i in enumerate(order):
        yield node, fills[i], k < CARRY and length - fills[i] >= least, bins[i]


PIECE = "doc_id {id}, piece int, start long, length int, crc long"


def cut(docs: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """Every text's pieces."""
    out = PIECE.format(id=docs.schema[0].dataType.simpleString())
    schema = arrow_schema(docs.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch in sliced(batches):
            found = [(doc, *p) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in pieces(tokens.ids(text or "") + b"\0\0\0\0", length)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, out)


def local(cut_: DataFrame, length: int) -> DataFrame:
    """Each partition's bins; all that have room are open."""
    out = BIN.format(id=cut_.schema[0].dataType.simpleString())
    schema = arrow_schema(cut_.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if found:
            placed = best_fit([p[3] for p in found], length)
            node = TaskContext.get().partitionId()
            yield from packed_rows(emit([[found[i] for i in b] for b in placed], [sum(found[i][3] for i in b) for b in placed], node, 1, length), schema)

    return cut_.mapInArrow(run, out)


def packed_rows(rows: Iterable[tuple[int, int, bool, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    names = ("doc_id", "piece", "start", "length", "crc")
    for at in range(0, len(rows), 4096):
        node, fill, is_open, members = zip(*rows[at : at + 4096], strict=True)
        members = [[dict(zip(names, m, strict=True)) for m in ms] for ms in members]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((node, fill, is_open, members), schema, strict=True)], schema=schema)


def best_fit_counts(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(fills, number of such bins): what best fit makes of so many items of each size, largest first.

    Items of one size are placed together: the bin that takes one is the fullest that holds the next one too.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    used, full = 0, []

    def keep(fills: tuple[int, ...], many: int, room: int) -> None:
        nonlocal used
        if not room:
            full.append((fills, many))
        elif many:
            rooms[room].append((fills, many))
            used |= 1 << room

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            if fits := used >> n:
                room = n + (fits & -fits).bit_length() - 1
                fills, many = rooms[room].pop()
                if not rooms[room]:
                    used ^= 1 << room
            else:
                room, fills, many = length, (), left
            each = room // n
            whole = min(many, left // each)
            if whole:
                keep(fills + (n,) * each, whole, room - each * n)
            left, many = left - whole * each, many - whole
            if many and left < each and left:
                keep(fills + (n,) * left, 1, room - left * n)
                left, many = 0, many - 1
            if many and fills:
                keep(fills, many, room)
    return full + [g for groups in rooms.values() for g in groups]


def by_counts(bins: DataFrame, length: int) -> DataFrame:
    """Bins packed into each other by best fit over their fills, however many they are."""
    spark = bins.sparkSession
    counts = {r["fill"]: r["n"] for r in bins.groupBy("fill").agg(F.count(F.lit(1)).alias("n")).collect()}  # length rows at most
    ranges, ranks, base = [], dict.fromkeys(counts, 0), 0
    for fills, many in best_fit_counts(counts, length):
        for at, fill in enumerate(fills):
            ranges.append((fill, ranks[fill], base, at))
            ranks[fill] += many
        base += many
    places = spark.createDataFrame(ranges, "fill int, from_rank long, base long, at int")
    places = places.groupBy("fill").agg(F.sort_array(F.collect_list(F.struct("from_rank", "base", "at")), asc=False).alias("ranges"))
    # A bin's rank in its fill: ranks inside a partition, behind the bins of partitions before.
    marked = saved(bins.withColumn("mark", F.monotonically_increasing_id()).withColumn("part", F.call_function("shiftright", F.col("mark"), F.lit(33))), "marked")
    sizes = marked.groupBy("fill", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("fill", "part", (F.sum("n").over(Window.partitionBy("fill").orderBy("part")) - F.col("n")).alias("before"))
    ranked = marked.withColumn("inside", F.row_number().over(Window.partitionBy("fill", "part").orderBy("mark")) - 1)
    ranked = ranked.join(before, ["fill", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    place = F.element_at(F.filter("ranges", lambda x: x["from_rank"] <= F.col("rank")), 1)
    placed = ranked.join(F.broadcast(places), "fill").withColumn("place", place)
    placed = placed.select((F.col("place.base") + F.col("rank") - F.col("place.from_rank")).alias("sequence"), F.col("place.at").alias("at"), "fill", "members")
    packed = placed.groupBy("sequence").agg(F.sum("fill").cast("int").alias("fill"), F.array_sort(F.collect_list(F.struct("at", "members"))).alias("parts"))
    return packed.select(F.lit(0).cast("long").alias("node"), "fill", F.lit(False).alias("open"), F.flatten(F.transform("parts", lambda p: p["members"])).alias("members"))


def merged(bins: DataFrame, least: int, length: int) -> DataFrame:
    """The bins of each group of FAN_IN nodes packed into each other."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bins.schema)
    schema = arrow_schema(bins.sparkSession, out)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fills, members = group.column("fill").to_pylist(), group.column("members").to_pylist()
        placed = best_fit(fills, length)
        rows = emit([[tuple(m.values()) for i in b for m in members[i]] for b in placed], [sum(fills[i] for i in b) for b in placed], key[0].as_py(), least, length)
        return pa.Table.from_batches(packed_rows(rows, schema), schema=schema)

    return bins.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("node").applyInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece. tokenizer: a local file that every executor has."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        pieces_ = saved(cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer, length), "pieces")
    bins = saved(local(pieces_.repartition(max(1, -(-pieces_.count() // PART))), length), "bins")
    least = bins.select(F.explode("members").alias("m")).agg(F.min("m.length")).first()[0] or 1
    done, waiting = [], bins
    nodes = (waiting.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        fits = F.col("open") & (F.lit(length) - F.col("fill") >= least)
        if nodes == 1 and done:
            done.append(waiting)
            break
        done.append(waiting.where(~fits))
        waiting = saved(merged(waiting.where(fits), least, length), "bins")
        nodes = -(-nodes // FAN_IN)
    rows = done[0]
    for df in done[1:]:
        rows = rows.unionByName(df)
    underfull = F.lit(length) - F.col("fill") >= least
    if not rows.where(underfull & ~F.col("open")).isEmpty():
        rows = rows.where(~underfull).unionByName(saved(by_counts(rows.where(underfull), length), "packed"))
    # A bin is known by its first member: a document's piece lies in one bin.
    rows = rows.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    before = lambda i: F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    out = rows.select("sequence_id", "members", F.posexplode("members").alias("at", "m"))
    return out.select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), F.col("m.crc").alias("ids_crc32"), "sequence_id", before(F.col("at")).alias("offset"))


def op7(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
