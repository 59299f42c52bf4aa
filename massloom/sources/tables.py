"""Tables: Parquet, CSV and TSV, and JSON state of resumable work."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

_folders: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for tables that a later step of one operator reads; they go when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _folders:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            return


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and predicates reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """one_file gathers the rows in one task: for results whose size their contract bounds, as a submission's."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path, sep=sep)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """From the files' footers alone."""
    return spark.read.parquet(path).count()


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys the finished table lacks: where a stopped job goes on."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def resolve_column(df: DataFrame, *names: str) -> str:
    """The one of the names that df has; an error for none or several."""
    found = [n for n in names if n in df.columns]
    if len(found) != 1:
        raise ValueError(f"expected one of {names}, found {found}")
    return found[0]


def json_manifest(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
