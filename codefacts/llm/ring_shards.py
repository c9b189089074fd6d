"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS equal cells. Each shard owns virtual nodes at cells; a row's key hashes to a cell
and belongs to the first virtual node at or after it. Rows are taken in ring order, and where a
shard is full its overflow continues clockwise to the next shard with room. As insertion order is
ring order, the walk needs no more than the count of rows in each cell: these counts (CELLS at most,
whatever the input) go to the driver, which returns the runs of ranks each shard takes from each cell,
CELLS + shards at most. That bounded table is broadcast; every row finds its shard from its rank
in its cell. A cell with many times the mean is ranked in the parts that hold its rows, each behind the parts before it.

The law is `rows`: capacities are the two whole numbers around the mean, so that counts are at most
one apart. With ``slack`` above 0 a capacity is ceil((1 + slack) * mean), which moves fewer rows when
a shard is added.

Defined cases: the key is the id together with the CRC-32 of the text, so rows without an id still
spread over cells as their texts differ; a null text has size 1 and the CRC of the empty text; repeated rows share a cell and take
following slots; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import saved, text_of

#: Cells of the ring (a power of two) and virtual nodes of a shard.
CELLS, VNODES = 1 << 14, 64
#: A cell is hot with so many times the mean, and so many rows at least.
HOT, LEAST_HOT = 16, 20_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node in ring order; a node's place depends on its shard alone."""
    return sorted((xxhash.xxh64_intdigest(f"{shard}/{v}") % CELLS, shard) for shard in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, shard, slot of that rank) for every run of ranks; counts: of rows in each cell."""
    nodes, room = ring(shards), capacities(sum(counts.values()), shards, slack)
    cells, used, runs = [c for c, _ in nodes], [0] * shards, []
    for cell in sorted(counts):
        left, at, rank = counts[cell], bisect_left(cells, cell), 0
        while left:
            shard = nodes[at % len(nodes)][1]
            if take := min(left, room[shard] - used[shard]):
                runs.append((cell, rank, shard, used[shard]))
                used[shard] += take
                left, rank = left - take, rank + take
            at += 1
    return runs


def hot_cells(counts: dict[int, int]) -> list[int]:
    """Cells with so many times the mean that their rows should not meet in one task: CELLS / HOT at most."""
    mean = sum(counts.values()) / CELLS
    return sorted(c for c, n in counts.items() if n > max(LEAST_HOT, HOT * mean))


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text_crc32")).withColumn("cell", F.shiftrightunsigned("place", 64 - CELLS.bit_length() + 1).cast("int"))
    rows = saved(rows.withColumn("part", F.spark_partition_id()), "ring")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    runs = docs.sparkSession.createDataFrame(walk(counts, shards, slack), "cell int, from_rank long, shard int, slot long")
    runs = runs.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("from_rank", "shard", "slot")), asc=False).alias("runs"))
    hot = hot_cells(counts)
    rows = rows.withColumn("part", F.when(F.col("cell").isin(hot), F.col("part")).otherwise(F.lit(-1)))
    parts = rows.where("part >= 0").groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("cell", "part", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "part").orderBy("place", "doc_id", "size")) - 1)
    if hot:
        ranked = ranked.join(before, ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    run = F.element_at(F.filter("runs", lambda x: x["from_rank"] <= F.col("rank")), 1)
    placed = ranked.join(F.broadcast(runs), "cell").withColumn("run", run)
    return placed.select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.from_rank")).alias("slot"))


def op2(docs: DataFrame, shards: int = 8) -> DataFrame:
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
