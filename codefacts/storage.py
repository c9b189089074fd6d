"""Reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting, as in tests, gets a temporary folder, which goes with the process. On a cluster
    executors would write to their own disks, so that the setting is required. What is written there stays for
    the session, as results are read from it when they are used; clearing the folder is its owner's part.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="codefacts-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends, and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
