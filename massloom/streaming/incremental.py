"""Incremental scoring: micro-batches of partial scores, merged by maximum.

An extension: the merge is commutative and idempotent, so replayed batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import finite
from ..operators.spectra import merge_scores


def merge_stream(scores: DataFrame, keys: list[str]) -> DataFrame:
    """A streaming aggregate: the greatest score of each key so far (output mode update or complete)."""
    return scores.groupBy(*keys).agg(F.max(finite(F.col("score"))).alias("score"))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_merged(scores: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Start a query that keeps, by batches, a Parquet version of the merged scores in path/version=<batch>."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = f"{path}/version={number - 1}"
        # no version before: a first batch after a clean start; one that can't be read is an error
        before = spark.read.parquet(last) if number and _exists(spark, last) else None
        merged = merge_scores(batch, keys=keys) if before is None else merge_scores(before, batch, keys=keys)
        merged.write.mode("overwrite").parquet(f"{path}/version={number}")

    return scores.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")
