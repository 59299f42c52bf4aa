"""SD files: records by $$$$, data items by tags. Chemistry stays outside: keys and texts come from tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chem import first_property
from ..operators.relational import dedupe_first

# The tags of bulk files.
FORMULA_TAGS = ("PUBCHEM_MOLECULAR_FORMULA",)
KEY_TAGS = ("PUBCHEM_IUPAC_INCHIKEY", "PUBCHEM_INCHIKEY")
CID_TAGS = ("PUBCHEM_COMPOUND_CID", "PUBCHEM_SUBSTANCE_ID")
SMILES_TAGS = ("PUBCHEM_OPENEYE_ISO_SMILES", "PUBCHEM_OPENEYE_CAN_SMILES", "PUBCHEM_SMILES", "PUBCHEM_CONNECTIVITY_SMILES")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(record): one row a record. Plain files are split at records and read by several tasks, gz files each by one."""
    return spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "").select(F.col("value").alias("record"))


def tag(record: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(record, f"(?s)> *<{name}>[^\n]*\n([^\n]*)", 1), F.lit(""))


def candidates(records: DataFrame) -> DataFrame:
    """(molecular_formula, pubchem_cid, full_inchikey, inchikey14, smiles) of records with formula, key and text."""
    of = lambda tags: first_property(*[tag(F.col("record"), t) for t in tags])
    out = records.select(of(FORMULA_TAGS).alias("molecular_formula"), of(CID_TAGS).try_cast("long").alias("pubchem_cid"), of(KEY_TAGS).alias("full_inchikey"), of(SMILES_TAGS).alias("smiles"))
    return out.na.drop(subset=["molecular_formula", "full_inchikey", "smiles"]).withColumn("inchikey14", F.substring("full_inchikey", 1, 14))


def matching_candidates(records: DataFrame, formulas: DataFrame, formula: str = "molecular_formula") -> DataFrame:
    """Candidates of the formulas, each (formula, skeleton) once: the least cid, nulls last."""
    found = candidates(records).join(formulas.select(formula).distinct(), formula, "left_semi")
    return dedupe_first(found, [formula, "inchikey14"], [F.asc_nulls_last("pubchem_cid"), F.asc("full_inchikey"), F.asc("smiles")])


def extraction_statistics(records: DataFrame, formulas: DataFrame, formula: str = "molecular_formula") -> DataFrame:
    """One row: records_seen, invalid_records (without any data item), matched_records (those of the formulas with key and
    text) and unique_candidates, the rows that matching_candidates keeps. One pass over the records."""
    of = lambda tags: first_property(*[tag(F.col("record"), t) for t in tags])
    valid = F.col("record").rlike("(?m)^> *.*<[^>\n]+>")
    rows = records.select(valid.alias("_valid"), of(FORMULA_TAGS).alias(formula), of(KEY_TAGS).alias("_key"), of(SMILES_TAGS).alias("_smiles"))
    marked = rows.join(formulas.select(formula).distinct().withColumn("_wanted", F.lit(True)), formula, "left")
    hit = F.coalesce(F.col("_wanted"), F.lit(False)) & F.col("_valid") & F.col("_key").isNotNull() & F.col("_smiles").isNotNull()
    return marked.agg(
        F.count("*").alias("records_seen"), F.count_if(~F.col("_valid")).alias("invalid_records"), F.count_if(hit).alias("matched_records"),
        F.count_distinct(F.when(hit, F.struct(F.col(formula), F.substring("_key", 1, 14)))).alias("unique_candidates"),
    )


PROPERTIES = "struct<PropertyTable:struct<Properties:array<struct<CID:bigint,MolecularFormula:string,InChIKey:string,SMILES:string,ConnectivitySMILES:string,CanonicalSMILES:string,IsomericSMILES:string>>>>"


def json_candidates(bodies: DataFrame, formula: str, body: str) -> DataFrame:
    """Candidates from property-table responses: rows of the asked formula with key and text, each skeleton once."""
    rows = bodies.select(formula, F.inline(F.from_json(body, PROPERTIES)["PropertyTable"]["Properties"]))
    smiles = first_property(*[F.col(c) for c in ("ConnectivitySMILES", "SMILES", "CanonicalSMILES", "IsomericSMILES")])
    good = rows.where((F.col("MolecularFormula") == F.col(formula)) & F.col("InChIKey").isNotNull()).select(F.col(formula).alias("molecular_formula"), F.col("CID").alias("pubchem_cid"), F.col("InChIKey").alias("full_inchikey"), F.substring("InChIKey", 1, 14).alias("inchikey14"), smiles.alias("smiles")).where("smiles is not null")
    return dedupe_first(good, ["molecular_formula", "inchikey14"], [F.asc_nulls_last("pubchem_cid"), F.asc("full_inchikey")])
