"""Chemistry as column expressions: adducts, formulas, mass errors, provenance of collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Masses in Da that results depend on.
PROTON = 1.007276466621
NA = 22.989218
K = 38.963158
NH4 = 18.033823
CL = 34.969402
FORMIC_ACID = 46.005479
H2O = 18.010565

# Monoisotopic masses of the supported elements.
ELEMENTS = {"H": 1.00782503223, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "P": 30.97376199842, "S": 31.9720711744, "Cl": 34.968852682, "Br": 78.9183376, "I": 126.904468, "B": 11.00930536, "Si": 27.976926535, "Se": 79.9165218}

# Adducts as (name, mass shift, molecules, charge).
ADDUCTS = (
    ("[M]+", 0.0, 1, 1),
    ("[M]-", 0.0, 1, -1),
    ("[M+H]+", PROTON, 1, 1),
    ("[M-H]-", -PROTON, 1, -1),
    ("[M+Na]+", NA, 1, 1),
    ("[M+K]+", K, 1, 1),
    ("[M+NH4]+", NH4, 1, 1),
    ("[M+CH2O2-H]-", FORMIC_ACID - PROTON, 1, -1),
    ("[M+Cl]-", CL, 1, -1),
    ("[M-H2O+H]+", PROTON - H2O, 1, 1),
    ("[M-2H2O+H]+", PROTON - 2 * H2O, 1, 1),
    ("[M-H2O-H]-", -H2O - PROTON, 1, -1),
    ("[2M+H]+", PROTON, 2, 1),
    ("[2M+Na]+", NA, 2, 1),
    ("[2M-H]-", -PROTON, 2, -1),
    ("[M+2H]2+", 2 * PROTON, 1, 2),
    ("[M+3H]3+", 3 * PROTON, 1, 3),
)

# The smaller table that formula hypotheses use; its formate shift differs by about 1.5e-6 Da.
HYPOTHESIS_SHIFTS = {"[M+H]+": 1.007276466621, "[M-H]-": -1.007276466621, "[M+Na]+": 22.989218, "[M+K]+": 38.963158, "[M+NH4]+": 18.033823, "[M+CH2O2-H]-": 44.998201, "[M+Cl]-": 34.969402}

# Collections by what their licence allows.
APPROVED = ("Wikidata Natural Products", "ChEBI NPs", "GNPS (Global Natural Products Social Molecular Networking)")
EXCLUDED = ("FooDB", "CMNPD", "Supernatural3", "NPASS", "NPAtlas", "DrugBankNP")
REVIEW_REQUIRED = ("Super Natural II", "ZINC NP", "InterBioScreen Ltd", "TCMDB-Taiwan (Traditional Chinese Medicine database)", "NPEdia", "UNPD (Universal Natural Products Database)", "CMAUP (cCollective molecular activities of useful plants)", "KNApSaCK", "PubChem NPs", "ChEMBL NPs")


def adducts(spark: SparkSession) -> DataFrame:
    """The adduct dimension: adduct, mass_shift, molecule_count, charge; 17 rows."""
    rows = ", ".join(f"('{n}', cast({s!r} as double), {m}, {c})" for n, s, m, c in ADDUCTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(adduct, mass_shift, molecule_count, charge)")


def neutral_mass(mz: Column, shift: Column, molecules: Column, charge: Column) -> Column:
    return (mz * F.abs(charge) - shift) / molecules


def precursor_mz(mass: Column, shift: Column, molecules: Column, charge: Column) -> Column:
    return (mass * molecules + shift) / F.abs(charge)


def with_neutral_mass(spectra: DataFrame, mz: str = "precursor_mz", adduct: str = "adduct") -> DataFrame:
    """spectra with neutral_mass, null for an unknown adduct. The dimension's size is fixed, so it is broadcast."""
    dim = F.broadcast(adducts(spectra.sparkSession).withColumnRenamed("adduct", "_adduct"))
    out = spectra.join(dim, F.col(adduct) == F.col("_adduct"), "left")
    return out.withColumn("neutral_mass", neutral_mass(F.col(mz), F.col("mass_shift"), F.col("molecule_count"), F.col("charge"))).drop(*dim.columns)


def _masses() -> Column:
    return F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])


def formula_parts(formula: Column) -> Column:
    """An array of (el, n) in order of appearance; null where the formula is malformed, charged or has unknown elements."""
    pattern = F.lit("([A-Z][a-z]?)([0-9]*)")
    els, counts = F.regexp_extract_all(formula, pattern, F.lit(1)), F.regexp_extract_all(formula, pattern, F.lit(2))
    parts = F.zip_with(els, counts, lambda e, n: F.struct(e.alias("el"), F.when(n == "", F.lit(1)).otherwise(n.try_cast("int")).alias("n")))
    known = F.array(*map(F.lit, ELEMENTS))
    good = F.forall(parts, lambda p: F.array_contains(known, p["el"]) & F.coalesce(p["n"] > 0, F.lit(False)))
    return F.when(formula.rlike("\\A([A-Z][a-z]?[0-9]*)+\\z") & good, parts)


def formula_composition(formula: Column) -> Column:
    """A map from element to count, repeated elements summed; null for a bad formula."""
    parts = formula_parts(formula)
    els = F.array_distinct(F.transform(parts, lambda p: p["el"]))
    count = lambda e: F.aggregate(F.filter(parts, lambda p: p["el"] == e), F.lit(0), lambda s, p: s + p["n"])
    return F.map_from_arrays(els, F.transform(els, count))


def monoisotopic_mass(formula: Column) -> Column:
    """The formula's mass; null for a bad formula."""
    return F.aggregate(formula_parts(formula), F.lit(0.0), lambda s, p: s + F.element_at(_masses(), p["el"]) * p["n"])


def mass_error_da(observed: Column, theoretical: Column) -> Column:
    return observed - theoretical


def mass_error_ppm(observed: Column, theoretical: Column) -> Column:
    """Relative to the theoretical mass; an error for a theoretical mass of 0."""
    bad = F.raise_error(F.lit("theoretical mass must not be zero"))
    return F.when(theoretical == 0, bad.cast("double")).otherwise((observed - theoretical) / theoretical * 1e6)


def mass_error_ppm_observed(observed: Column, theoretical: Column) -> Column:
    """(theoretical - observed) relative to the observed mass, as formula hypotheses have it."""
    return F.try_divide(theoretical - observed, observed) * 1e6


def parse_collections(value: Column) -> Column:
    """Names of a pipe-separated list: trimmed, empty ones dropped, each once; none for null."""
    names = F.filter(F.transform(F.split(value, "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def _of(names) -> Column:
    return F.array(*map(F.lit, names))


def classify_collections(names: Column, approved=APPROVED, review=REVIEW_REQUIRED, excluded=EXCLUDED) -> Column:
    """approved, else needs_review for an unknown collection, else review_required, excluded, no_provenance."""
    unknown = F.size(F.array_except(names, _of([*approved, *review, *excluded]))) > 0
    return (
        F.when(F.arrays_overlap(names, _of(approved)), "approved")
        .when(unknown, "needs_review")
        .when(F.arrays_overlap(names, _of(review)), "review_required")
        .when(F.arrays_overlap(names, _of(excluded)), "excluded")
        .otherwise("no_provenance")
    )


def approved_collections(names: Column, approved=APPROVED) -> Column:
    return F.array_intersect(names, _of(approved))


def is_approved(names: Column, approved=APPROVED) -> Column:
    return F.arrays_overlap(names, _of(approved))


def inchikey14(key: Column) -> Column:
    """The skeleton part of a full key; null if it has not the shape of one."""
    return F.when(key.rlike("\\A.{14}-.{10}-.\\z"), F.substring(key, 1, 14))


def first_property(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def flipped_mode(mode: Column, pairs=(("positive", "negative"),)) -> Column:
    return reduce(lambda out, p: F.when(mode == p[0], p[1]).when(mode == p[1], p[0]).otherwise(out), pairs, F.lit(None).cast("string"))
