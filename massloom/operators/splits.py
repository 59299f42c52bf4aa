"""Leakage-safe splits: retrieval benchmarks, library quotas, train/validation manifests.

Random choices go by the hash of a seed and the key, the same on every run and any number of machines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder
from .relational import assert_unique, require_columns

# Structures to take from each library, for each of the two sets; below, the library that is left out.
DEFAULT_QUOTAS = {"gnps": 400, "pluskal_ms2": 350, "riken": 350, "mona": 300, "msdial": 200, "massbank": 200, "enveda-180": 150, "drug_plus": 50}


@dataclass(frozen=True)
class SplitConfig:
    quotas: dict[str, int] = field(default_factory=DEFAULT_QUOTAS.copy)
    seed: int = 42
    excluded: tuple[str, ...] = ("enveda-np-examples",)


def seeded(key: Column, seed: int) -> Column:
    """The order of a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def retrieval_benchmark(spectra: DataFrame, manifest: DataFrame, key: str, library: str, query_library: str = "query_library") -> tuple[DataFrame, DataFrame]:
    """(queries, reference): a manifest structure's spectra of its query library, and all other spectra.

    An error for a repeated manifest key, or one that produced no query.
    """
    require_columns(spectra, key, library)
    require_columns(manifest, key, query_library)
    assert_unique(manifest, [key], "manifest")
    pairs = manifest.select(key, F.col(query_library).alias(library))
    queries = spectra.join(pairs, [key, library], "left_semi")
    if not manifest.join(queries, key, "left_anti").isEmpty():
        raise ValueError("manifest keys without a query spectrum")
    return queries, spectra.join(pairs, [key, library], "left_anti")


def retrieval_split(metadata: DataFrame, key: str, library: str, config: SplitConfig) -> DataFrame:
    """(key, query_library, part, counts): 2 * quota structures of each library, half for dev and half for holdout.

    A structure is eligible with two libraries or more, excluded ones apart. Libraries choose in order of quota, largest
    first, and no structure is chosen twice.

    The eligible rows are written once, by library; each library reads its own part, leaves out what is taken and appends
    its choice, 2 * quota rows at most. So every step's plan is as large as the first one's, and the result is one scan.
    """
    spark = metadata.sparkSession
    rows = metadata.where(~F.col(library).isin(list(config.excluded))).na.drop(subset=[key, library])
    counts = rows.groupBy(key, library).agg(F.count("*").alias("query_spectrum_count"))
    eligible = counts.groupBy(key).agg(F.countDistinct(library).alias("_libs"), F.sum("query_spectrum_count").alias("_all")).where("_libs >= 2")
    pool = counts.where(F.col(library).isin(list(config.quotas))).join(eligible, key)
    folder = new_folder(spark, "split")
    pool.write.partitionBy(library).parquet(f"{folder}/pool")
    pool = spark.read.schema(pool.schema).parquet(f"{folder}/pool")
    order = F.row_number().over(Window.partitionBy(library).orderBy(seeded(F.concat_ws("|", F.col(library), F.col(key)), config.seed), F.col(key)))
    out = pool.withColumn("part", F.lit("")).schema
    for turn, (name, quota) in enumerate(sorted(config.quotas.items(), key=lambda kv: (-kv[1], kv[0]))):
        free = pool.where(F.col(library) == name)
        if turn:
            free = free.join(spark.read.schema(out).parquet(f"{folder}/taken").select(key), key, "left_anti")
        part = F.when(F.col("_n") <= quota, "dev").otherwise("holdout")
        free.withColumn("_n", order).where(F.col("_n") <= 2 * quota).withColumn("part", part).drop("_n").write.parquet(f"{folder}/taken/turn={turn}")
    chosen = spark.read.schema(out).parquet(f"{folder}/taken")
    return chosen.select(key, F.col(library).alias("query_library"), "part", (F.col("_libs") - 1).alias("reference_library_count"), "query_spectrum_count", (F.col("_all") - F.col("query_spectrum_count")).alias("reference_spectrum_count"))


def structure_split(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """(key, part): the first round(n * fraction) structures of a seeded order validate, the others train.

    The numbering is per salted prefix of the order, so no single task holds all keys: the cut is the smallest hash
    beyond, found by one exact percentile of counts.
    """
    keys = rows.select(key).na.drop().distinct().withColumn("_o", seeded(F.col(key), seed))
    prefix = keys.groupBy(F.substring("_o", 1, 3).alias("_p")).agg(F.count("*").alias("_c"))  # 4096 rows at most
    before = prefix.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    numbered = keys.withColumn("_p", F.substring("_o", 1, 3)).withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_o", key))).join(F.broadcast(before), "_p")
    limit = F.bround(F.col("_total") * F.lit(fraction))
    return numbered.select(key, F.when(F.col("_before") + F.col("_n") <= limit, "validation").otherwise("train").alias("part"))


def domain_keys(rows: DataFrame, key: str, library: str, name: str) -> DataFrame:
    return rows.where(F.col(library) == name).select(key, library).distinct()


def filter_to_training(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of training structures alone; an empty set of keys is an error."""
    if keys.isEmpty():
        raise ValueError("no training keys")
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def write_manifest(parts: dict[str, DataFrame], folder: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
