"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Memtables: each input partition is sorted by digest and flushed as one run. Compaction merges all
runs by digest and keeps the smallest identifier of each: the longest original, then the smallest id. The
compacted level has a blocked Bloom filter of the digests that several rows have (FILTER words of 64
bits at most, whatever the input), which every row of the runs is probed against where it lies. What
does not pass is a class of its own and is neither shuffled nor joined. Rows that pass meet the level; those whose
digest a kept row has already are hits, and each hit is compared with the kept row byte by byte. Rows that
fail that comparison are grouped by their whole text instead.

At scale: compaction moves digests only (partial aggregation takes hot digests); texts move only of
rows that pass the filter, once to their class and, for hits, once to be compared. Both are plain equi joins, so that
AQE splits the partition of a hot group. With many more repeated digests than the filter has words it lets more
rows pass; results stay the same and texts then move once more. Nothing is collected.

Defined cases: null texts count as empty; null ids sort after all others; repeated rows (same id,
same text) keep exactly one row; texts of any length are read whole; an empty table gives an empty result;
other columns of the input, whatever their names, are carried inside a struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import bloom, maybe_in, saved, text_of

#: Characters that do not count when texts are compared.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: str | Column) -> Column:
    return F.translate(text_of(text), WHITE, "")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))


class Index:
    """Runs, their compaction, the filter of repeated digests and the verified hits of one table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> None:
        self.body = normalised(f"row.{text_col}")
        self.id = F.col(f"row.{id_col}")
        log = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        flushed = log.select("row", F.monotonically_increasing_id().alias("tag"), digest(self.body).alias("digest"), F.length(text_of(f"row.{text_col}")).alias("points"))
        self.runs = saved(flushed.sortWithinPartitions("digest"), "runs")
        self.level = saved(self.compacted(self.runs, "digest"), "level")
        self.filter = bloom(self.level.where("size > 1"), "digest")
        probed = maybe_in(self.runs, "digest", self.filter)
        #: Rows whose digest no other row has, by the filter: they pass where they lie.
        self.single = probed.where("not maybe").select("row", "tag", "digest")
        #: All others with their class; those that the filter let through by chance are alone in it.
        # The same plan at every size: few groups with copies are not broadcast.
        several = self.level.where("size > 1").withColumnRenamed("digest", "of")
        members = probed.where("maybe").select("row", "tag", "digest").join(several.hint("merge"), F.col("digest") == F.col("of"), "left")
        members = members.select("row", "tag", "digest", F.when(F.col("of").isNull(), self.id).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_tag", "tag").alias("keep_tag"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
        self.members = saved(members, "members")
        self.odd = saved(self.verified().where("not same"), "odd")
        self.collided = not self.odd.isEmpty()

    def compacted(self, runs: DataFrame, *by: str) -> DataFrame:
        """One row for each class: its kept row's id and tag, and its number of rows."""
        best = F.min(F.struct((-F.col("points")).alias("shorter"), self.id.isNull().alias("without"), self.id.alias("id"), "tag"))
        return runs.groupBy(*by).agg(best.alias("best"), F.count(F.lit(1)).alias("size")).select(*by, F.col("best.id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), "size")

    def verified(self) -> DataFrame:
        """The hits, each compared with its kept row byte by byte."""
        keepers = self.members.where("tag = keep_tag and size > 1").select(F.col("digest").alias("of"), self.body.alias("kept_body"))
        hits = self.members.where("tag <> keep_tag").select("digest", "tag", self.body.alias("body"))
        return hits.join(keepers.hint("merge"), F.col("digest") == F.col("of")).select("digest", "tag", (F.col("body") == F.col("kept_body")).alias("same"))

    def classes(self) -> DataFrame:
        """tag, doc_id, keep_id, group_size, kept, digest: one row for each input row."""
        columns = ("tag", "doc_id", "keep_id", "group_size", "kept", "digest")
        single = self.single.select("tag", self.id.alias("doc_id"), self.id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
        return single.unionByName(self.decided(self.id.alias("doc_id")).select(*columns))

    def decided(self, *columns: str | Column) -> DataFrame:
        """The members with further columns, each with keep_id, group_size and kept."""
        of = self.members.select("tag", "digest", "keep_id", F.col("size").alias("group_size"), (F.col("tag") == F.col("keep_tag")).alias("kept"), *columns)
        if not self.collided:
            return of
        # Digests that collide: these rows leave their class and are grouped by digest and whole text.
        less = self.odd.groupBy("digest").agg(F.count(F.lit(1)).alias("odd"))
        inside = of.join(less, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("odd", F.lit(0))).join(self.odd.select("tag"), "tag", "left_anti")
        apart = saved(self.runs.join(self.odd.select("tag"), "tag", "left_semi").withColumn("body", self.body), "apart")
        own = self.compacted(apart, "digest", "body")
        regrouped = apart.select("digest", "body", "tag", *columns).join(own, ["digest", "body"])
        return inside.drop("odd").unionByName(regrouped.withColumn("group_size", F.col("size")).withColumn("kept", F.col("tag") == F.col("keep_tag")).drop("body", "size", "keep_tag"))

    def kept_rows(self) -> DataFrame:
        """The input rows that stay, with their columns as they were."""
        return self.single.select("row.*").unionByName(self.decided("row").where("kept").select("row.*"))


def op8(docs: DataFrame, **options) -> DataFrame:
    classes = Index(docs.select("doc_id", "text"), **options).classes()
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), r AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         row_number() OVER w AS place,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""
