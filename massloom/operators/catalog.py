"""Formula and structure catalogues: builders, look-ups, conflicts, candidate burden and bucketed assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import finite
from .relational import band_join, dedupe_first, require_columns


def build_formula_index(rows: DataFrame, formula: str = "formula", mass: str = "monoisotopic_mass") -> DataFrame:
    """(formula, monoisotopic_mass), each formula once; an error where a formula has masses over 1e-9 apart."""
    require_columns(rows, formula, mass)
    m = finite(F.col(mass).cast("double"))
    spread = F.max("_m") - F.min("_m")
    one = F.when(spread <= 1e-9, F.min("_m")).otherwise(F.raise_error(F.concat(F.lit("inconsistent masses of "), F.col(formula))).cast("double"))
    return rows.select(F.col(formula), m.alias("_m")).where("_m is not null").groupBy(formula).agg(one.alias(mass))


def search_formulas(queries: DataFrame, index: DataFrame, q_mass: str, mass: str = "monoisotopic_mass", ppm: float = 10.0) -> DataFrame:
    """queries with every formula within ppm of the observed mass."""
    return band_join(queries, index, q_mass, mass, ppm, how="ppm")


def build_structure_index(rows: DataFrame, key: str, smiles: str, formula: str, mass: str) -> DataFrame:
    """One row a structure; an error where a structure has two texts, formulas or masses (over 1e-9 apart)."""
    good = rows.select(key, smiles, formula, finite(F.col(mass).cast("double")).alias(mass)).where(F.col(mass).isNotNull())
    same = (F.min(smiles) == F.max(smiles)) & (F.min(formula) == F.max(formula)) & (F.max(mass) - F.min(mass) <= 1e-9)
    bad = F.raise_error(F.concat(F.lit("inconsistent structure "), F.col(key))).cast("string")
    return good.groupBy(key).agg(F.when(same, F.min(smiles)).otherwise(bad).alias(smiles), F.min(formula).alias(formula), F.min(mass).alias(mass))


def structures_for_formulas(index: DataFrame, formulas: DataFrame, formula: str) -> DataFrame:
    return index.join(formulas.select(formula).distinct(), formula, "left_semi")


def resolve_structure_metadata(rows: DataFrame, key: str, smiles: str, formula: str) -> DataFrame:
    """Of each structure its most frequent (text, formula); ties to the least formula, then text. Nulls are dropped."""
    counts = rows.na.drop(subset=[key, smiles, formula]).groupBy(key, smiles, formula).agg(F.count("*").alias("n"))
    return dedupe_first(counts, [key], [F.desc("n"), F.asc(formula), F.asc(smiles)]).drop("n")


def allowed_catalog(training: DataFrame, other: DataFrame, key: str, smiles: str, formula: str) -> DataFrame:
    """Resolved structures of both tables, with in_training and in_other; training's text stands where both have one.

    Structures whose formulas differ between the tables are left out of both.
    """
    t, o = (resolve_structure_metadata(x, key, smiles, formula) for x in (training, other))
    both = t.select(key, F.col(smiles).alias("_s"), F.col(formula).alias("_f"), F.lit(True).alias("_t")).join(o.withColumn("_o", F.lit(True)), key, "full_outer")
    agreeing = both.where(F.coalesce(F.col("_f") == F.col(formula), F.lit(True)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return agreeing.select(key, F.coalesce("_s", smiles).alias(smiles), F.coalesce("_f", formula).alias(formula), flag(F.col("_t")).alias("in_training"), flag(F.col("_o")).alias("in_other"))


def by_precedence(parts: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of named tables, each key from the first that has it, with its name in source."""
    out = None
    for i, (name, df) in enumerate(parts):
        df = df.withColumn("source", F.lit(name)).withColumn("_turn", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = [F.asc(c) for c in out.columns if c not in (*keys, "_turn", "source")]
    return dedupe_first(out, keys, [F.asc("_turn"), *rest]).drop("_turn")


def candidate_burden(candidates: DataFrame, requested: DataFrame, formula: str, key: str) -> DataFrame:
    """Distinct candidates of every requested formula, 0 where there is none."""
    counts = candidates.groupBy(formula).agg(F.countDistinct(key).alias("candidate_count"))
    return requested.select(formula).distinct().join(counts, formula, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0).cast("long")))


def bucket(key: Column, buckets: int = 256) -> Column:
    """The first 8 bytes of the key's SHA-256, big-endian, modulo buckets."""
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % buckets).cast("int")


def write_bucketed(candidates: DataFrame, path: str, formula: str, key: str, buckets: int = 256, order: list[Column] | None = None) -> None:
    """Candidates once by (formula, key) in Parquet folders by bucket of the formula."""
    once = dedupe_first(candidates, [formula, key], order or [F.asc_nulls_last(c) for c in candidates.columns if c not in (formula, key)] or [F.asc(key)])
    placed = once.withColumn("bucket", bucket(F.col(formula), buckets))
    placed.repartition("bucket").sortWithinPartitions("bucket", formula, key).write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_bucketed(assets: DataFrame, formulas: list[str], formula: str, key: str, buckets: int = 256, known: DataFrame | None = None) -> DataFrame:
    """Candidates of the formulas: only their buckets' folders are read. With known (formula), a missing one is an error.

    formulas is what a caller asks for, a list of its own; no formula gives no row.
    """
    spark = assets.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, formulas)) if formulas else F.array().cast("array<string>")).alias(formula)).distinct()
    if known is not None:
        missing = [r[0] for r in wanted.join(known.select(formula), formula, "left_anti").limit(10).collect()]
        if missing:
            raise KeyError(f"formulas without a bucket: {missing}")
    places = sorted({r[0] for r in wanted.select(bucket(F.col(formula), buckets)).collect()})
    return assets.where(F.col("bucket").isin(places)).join(F.broadcast(wanted), formula, "left_semi").transform(lambda df: dedupe_first(df, [formula, key], [F.asc_nulls_last(c) for c in df.columns if c not in (formula, key)] or [F.asc(key)]))


def collection_counts(names: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the members of an array column, and of its combinations."""
    each = names.select(F.explode(column).alias("collection")).groupBy("collection").agg(F.count("*").alias("n"))
    combined = names.groupBy(F.array_join(F.array_sort(column), "|").alias("combination")).agg(F.count("*").alias("n"))
    return each, combined
