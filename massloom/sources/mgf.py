"""MGF peak files: parse, write, rewrite. A block is the text from BEGIN IONS to END IONS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import assert_unique


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, title, fields map, mzs, intensities, block): one row a block, files split at BEGIN IONS.

    Errors: a block without END IONS or FEATURE_ID. check_features() finds repeated ids.
    """
    raw = spark.read.option("lineSep", "BEGIN IONS").text(path).where(F.trim("value") != "")
    # text before a file's first block (a header) has neither an end nor a line of a block
    raw = raw.where(~((F.instr("value", "END IONS") == 0) & ~F.col("value").rlike("(?m)^(FEATURE_ID|TITLE|PEPMASS|CHARGE)=|^[0-9.]+[ \t]")))
    ended = F.instr("value", "END IONS") > 0
    body = F.when(ended, F.substring_index("value", "END IONS", 1)).otherwise(F.raise_error(F.lit("unterminated block")).cast("string"))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")
    rows = raw.select(lines.alias("_l"))
    fields = F.filter("_l", lambda x: x.rlike("^[A-Z_0-9]+="))
    peaks = F.filter("_l", lambda x: x.rlike("^[0-9.]"))
    rows = rows.select(F.map_from_arrays(F.array_distinct(F.transform(fields, lambda x: F.substring_index(x, "=", 1))), F.transform(F.array_distinct(F.transform(fields, lambda x: F.substring_index(x, "=", 1))), lambda k: F.regexp_replace(F.filter(fields, lambda x: F.startswith(x, F.concat(k, F.lit("="))))[0], "^[A-Z_0-9]+=", ""))).alias("fields"), F.transform(peaks, lambda x: F.split(x, "[ \t]+")).alias("_p"), F.concat(F.lit("BEGIN IONS\n"), F.array_join("_l", "\n"), F.lit("\nEND IONS")).alias("block"))
    feature = F.coalesce(F.col("fields").getItem("FEATURE_ID"), F.raise_error(F.lit("block without FEATURE_ID")).cast("string"))
    number = lambda i: F.transform("_p", lambda p: p[i].cast("double"))
    return rows.select(feature.alias("feature_id"), F.col("fields").getItem("TITLE").alias("title"), "fields", number(0).alias("mzs"), number(1).alias("intensities"), "block")


def check_features(blocks: DataFrame) -> DataFrame:
    return assert_unique(blocks, ["feature_id"], "blocks")


def peak_lines(mzs: Column, intensities: Column, digits: int = 6) -> Column:
    """Lines 'mz intensity' of two arrays of one length."""
    line = F.zip_with(mzs, intensities, lambda m, i: F.format_string(f"%.{digits}f %.{digits}f", m, i))
    return F.when(F.size(mzs) == F.size(intensities), line).otherwise(F.raise_error(F.lit("peak arrays differ in length")).cast("array<string>"))


def blocks(df: DataFrame, fields: dict[str, str], mzs: str, intensities: str) -> DataFrame:
    """(value): an MGF block of each row, with the fields NAME: column in order."""
    head = [F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in fields.items()]
    lines = F.concat(F.array(F.lit("BEGIN IONS"), *head), peak_lines(F.col(mzs), F.col(intensities)), F.array(F.lit("END IONS"), F.lit("")))
    return df.select(F.array_join(lines, "\n").alias("value"))


def write_mgf(df: DataFrame, path: str, fields: dict[str, str], mzs: str, intensities: str) -> None:
    blocks(df, fields, mzs, intensities).write.text(path)


def rewrite(block: Column, **values: Column) -> Column:
    """A block with the values of fields replaced; fields that it lacks stay away."""
    for name, value in values.items():
        at = f"(?m)^{name}=.*$"
        block = F.when(block.rlike(at), F.concat(F.regexp_replace(F.regexp_extract(block, f"(?ms)\\A(.*?)^{name}=", 1), "\\z", ""), F.lit(f"{name}="), value, F.regexp_extract(block, f"(?ms)^{name}=[^\n]*(.*)\\z", 1))).otherwise(block)
    return block
