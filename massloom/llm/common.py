"""What the training-data operators share: scratch tables, lets in SQL expressions, union-find."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract of this package.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where that is unset on a local master, as in tests, one of
    our own. A cluster without the setting is refused: a folder of the driver's machine would lose what others write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="massloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        _written.append((spark, base))
    return base.rstrip("/")


def scratch(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs a re-read.

    by: a column of few values to part the files by. The table goes when the driver ends, or earlier by drop(); if the
    driver is killed, it stays in the shared folder, under a name that no other run reads.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(trimmed != "", F.split(trimmed, WORD_SPLIT)).otherwise(F.array().cast("array<string>"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Distributed union-find: (node, component), component the least node that links reach.

    edges has (a, b), longs, in any direction, repeats allowed; nodes without an edge to another node are absent.
    Alternates large-star and small-star hooks. Each hook takes a grouped minimum (combined before its shuffle) and an
    equi join that adaptive execution may split, so that a hub with a third of all nodes never meets in one task. Every
    round ends in a scratch table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = scratch(pairs.distinct(), name)
    digest = _digest(now)
    while digest[0]:
        # large star: every larger neighbour of a node hangs on the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            now.join(low.withColumnRenamed("u", "v"), "v")
            .select("u", "m")
            .where("u <> m")
            .distinct()
            .withColumnRenamed("m", "v")
        )
        # small star: a node and its smaller neighbours hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = scratch(small, name)
        before, digest = digest, _digest(after)
        drop(now)
        now = after
        if before == digest and _is_forest(now):
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(pairs: DataFrame):
    return pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def _is_forest(pairs: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    twice = pairs.groupBy("u").count().where("count > 1")
    return twice.isEmpty() and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
