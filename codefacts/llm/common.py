"""What the corpus operators share: tables, the shared folder, Arrow batches, Bloom filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.storage import saved, shared_dir

#: Rows of an Arrow batch of texts, which may be long, and of those that are Python objects at a time.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own readers: the folder may be in a store that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a Bloom filter: a broadcast table of 2 MB.
FILTER = 1 << 17


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """word, bits: a blocked Bloom filter of a key, FILTER rows at most whatever the input."""
    return saved(keys.groupBy(word(F.col(key)).alias("word")).agg(F.bit_or(mask(F.col(key))).alias("bits")), "filter")


def maybe_in(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """The rows with a column ``maybe``: false where the key is certainly not in the filter. No row is shuffled."""
    probed = rows.join(F.broadcast(filter_), word(F.col(key)) == F.col("word"), "left")
    own = mask(F.col(key))
    return probed.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(own) == own, F.lit(False))).drop("word", "bits")


def word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER)).cast("int")


def mask(key: Column) -> Column:
    """A key's three bits in its word."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, n).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another bound of Arrow batches for jobs that run inside; the session's own comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches (Spark bounds their bytes) in parts of so many rows: no more become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapped(df: DataFrame, make: Callable[[], Callable[[list, list], list[list]]], schema: str, kept: pa.DataType | None = None) -> DataFrame:
    """Apply a function of (ids, texts) to a frame of an id and a text column, and write the result.

    The result is small beside the texts; it is written at once, as the bound of the Arrow batches that go to Python holds for
    that job alone. ``make()`` runs once in a task and returns the function; the function returns the columns that
    follow the id. Null texts arrive as ''.
    """
    id_name = df.columns[0]
    out = arrow_schema(df.sparkSession, f"`{id_name}` {df.schema[0].dataType.simpleString()}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = work(batch.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    with arrow_batches(df.sparkSession, BATCH_ROWS):
        return saved(df.mapInArrow(run, f"`{id_name}` {df.schema[0].dataType.simpleString()}, {schema}"), "mapped")


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def text_of(text: str | Column = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
