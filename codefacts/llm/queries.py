"""The operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codefacts.llm import ball_simhash, license_scan, lsm_dedup, mtree_topk, ordinal_quality, prefix_bpe, residual_packing, ring_shards, toxicity_knn, warc_zstd
from codefacts.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over = lambda f, *names: lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])
    return {
        "op1_warc_zstd": over(warc_zstd.op1, "pages"),
        "op2_ring_shards": over(ring_shards.op2, "documents"),
        "op3_license_scan": over(license_scan.op3, "documents"),
        "op4_mtree_topk": over(mtree_topk.op4, "embeddings"),
        "op5_toxicity_knn": over(toxicity_knn.op5, "documents", "labels"),
        "op6_ordinal_quality": over(ordinal_quality.op6, "documents", "labels"),
        "op7_residual_packing": over(residual_packing.op7, "documents"),
        "op8_lsm_dedup": over(lsm_dedup.op8, "documents"),
        "op9_ball_simhash": over(ball_simhash.op9, "documents"),
        "op10_prefix_bpe": over(prefix_bpe.op10, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zstd": warc_zstd.OP1_SQL, "op4_mtree_topk": mtree_topk.OP4_SQL, "op8_lsm_dedup": lsm_dedup.OP8_SQL}
