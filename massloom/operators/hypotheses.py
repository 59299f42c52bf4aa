"""Formula hypotheses of molecules with several spectra: which spectra count, which formulas fit, and what stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import HYPOTHESIS_SHIFTS, mass_error_ppm
from ..functions.metrics import finite
from .relational import band_join, dedupe_first

#: The adduct that goes before all others, the width of a match, the names of the two reasons, the columns.
PRIMARY = "[M+H]+"
TOLERANCE_PPM = 10.0
REASONS = ("primary_hplus", "fallback_supported_adduct")
COLUMNS = (
    "molecule_id source_test_row_id source_spectrum_id selected_spectrum_id selected_adduct selected_ionization_mode selection_reason precursor_mz selected_precursor_mz"
    " neutral_mass molecular_formula candidate_formula formula_monoisotopic_mass selected_mass_error_ppm selected_abs_mass_error_ppm mist_processable"
    " mist_usable_peak_count spectrum_support_count selected_spectrum_count spectrum_support_fraction min_abs_mass_error_ppm hypothesis_spec"
).split()


def choose_spectra(spectra: DataFrame) -> DataFrame:
    """A molecule's spectra of the primary adduct, or, where it has none, those of an adduct with a known shift.

    spectra: molecule_id, adduct, precursor_mz and others, which pass through; selection_reason and neutral_mass are added.
    Whether a molecule has the primary adduct is a window over it; a molecule without any supported adduct has no row.
    """
    primary = F.coalesce(F.col("adduct") == PRIMARY, F.lit(False))
    shift = F.create_map(*[F.lit(v) for pair in HYPOTHESIS_SHIFTS.items() for v in pair])
    rows = spectra.withColumn("_shift", F.try_element_at(shift, F.col("adduct"))).withColumn("_any", F.bool_or(primary).over(Window.partitionBy("molecule_id")))
    kept = rows.where(F.when(F.col("_any"), primary).otherwise(F.col("_shift").isNotNull()))
    return kept.select(*spectra.columns, F.when(F.col("_any"), REASONS[0]).otherwise(REASONS[1]).alias("selection_reason"), finite(F.col("precursor_mz") - F.col("_shift")).alias("neutral_mass"))


def formula_hypotheses_in_full(spectra: DataFrame, index: DataFrame, tolerance: float = TOLERANCE_PPM) -> DataFrame:
    """COLUMNS: a row a (molecule, formula) with its representative spectrum, its support and a numbered id.

    spectra: molecule_id, source_test_row_id, spectrum_id, adduct, ionization_mode, precursor_mz, mist_usable_peak_count.
    index: molecular_formula, monoisotopic_mass. A formula fits within tolerance ppm of the spectrum's neutral mass, a band
    of its own width a row. Its representative is usable rather than not, then nearest, then that with more usable peaks,
    then the least row. Support counts spectra, and its fraction is of all the molecule's chosen ones, matched or not. Ids
    number a molecule's formulas from 0 by their least error, then formula.
    """
    chosen = choose_spectra(spectra)
    totals = chosen.groupBy("molecule_id").agg(F.count_distinct("spectrum_id").alias("selected_spectrum_count"))
    near = band_join(chosen, index.select("molecular_formula", F.col("monoisotopic_mass").alias("formula_monoisotopic_mass")), "neutral_mass", "formula_monoisotopic_mass", tolerance, how="ppm")
    error = mass_error_ppm(F.col("neutral_mass"), F.col("formula_monoisotopic_mass"))
    matches = near.withColumns({"selected_mass_error_ppm": error, "selected_abs_mass_error_ppm": F.abs(error), "mist_processable": F.coalesce(F.col("mist_usable_peak_count") > 0, F.lit(False))})
    keys = ["molecule_id", "molecular_formula"]
    support = matches.groupBy(*keys).agg(F.count_distinct("spectrum_id").alias("spectrum_support_count"), F.min("selected_abs_mass_error_ppm").alias("min_abs_mass_error_ppm"))
    order = [F.desc("mist_processable"), F.asc("selected_abs_mass_error_ppm"), F.desc_nulls_last("mist_usable_peak_count"), F.asc("source_test_row_id")]
    out = dedupe_first(matches, keys, order).join(support, keys).join(totals, "molecule_id")
    number = F.row_number().over(Window.partitionBy("molecule_id").orderBy("min_abs_mass_error_ppm", "molecular_formula")) - 1
    named = {
        "source_spectrum_id": F.col("spectrum_id"), "selected_spectrum_id": F.col("spectrum_id"), "selected_adduct": F.col("adduct"), "selected_ionization_mode": F.col("ionization_mode"),
        "selected_precursor_mz": F.col("precursor_mz"), "candidate_formula": F.col("molecular_formula"), "spectrum_support_fraction": F.col("spectrum_support_count") / F.col("selected_spectrum_count"),
        "hypothesis_spec": F.format_string("%s__formula_%04d", F.col("molecule_id").cast("string"), number),
    }
    return out.withColumns(named).select(*COLUMNS)


def tolerance_recall(spectra: DataFrame, index: DataFrame, tolerances: tuple[float, ...]) -> DataFrame:
    """A row a tolerance: of the structures with a truth in the index and a usable spectrum, how many have it among the
    formulas that any of their spectra fits, how many of these not at the tolerance before, and the formulas to look at.

    spectra: structure, molecular_formula, neutral_mass. A structure's truth is its most frequent formula, ties to the
    least. The band join runs once, at the widest tolerance; each (structure, formula) keeps the least tolerance it needs.
    """
    named = spectra.where("molecular_formula is not null").groupBy("structure", "molecular_formula").agg(F.count("*").alias("_n"))
    truth = dedupe_first(named, ["structure"], [F.desc("_n"), F.asc("molecular_formula")]).select("structure", F.col("molecular_formula").alias("_truth"))
    known = truth.join(index.select(F.col("molecular_formula").alias("_truth")).distinct(), "_truth", "left_semi")
    usable = spectra.where(finite(F.col("neutral_mass").cast("double")).isNotNull()).select("structure", "neutral_mass").join(known, "structure")
    near = band_join(usable, index.select("molecular_formula", F.col("monoisotopic_mass").alias("_mass")), "neutral_mass", "_mass", max(tolerances), how="ppm")
    needed = near.groupBy("structure", "_truth", "molecular_formula").agg(F.min(F.abs(F.col("_mass") - F.col("neutral_mass")) / F.col("neutral_mass") * 1e6).alias("_need"))
    hit, within = F.max(F.when(F.col("molecular_formula") == F.col("_truth"), F.col("_need"))), lambda t: F.count_if(F.col("_need") <= t)
    each = usable.select("structure").distinct().join(needed.groupBy("structure").agg(hit.alias("_hit"), *[within(t).alias(f"_c{k}") for k, t in enumerate(tolerances)]), "structure", "left")
    before = lambda k: (F.col("_hit") > tolerances[k - 1]) if k else F.lit(True)
    sums = each.agg(
        F.count("*").alias("structures"),
        *[F.count_if(F.col("_hit") <= t).alias(f"_h{k}") for k, t in enumerate(tolerances)], *[F.count_if((F.col("_hit") <= t) & before(k)).alias(f"_r{k}") for k, t in enumerate(tolerances)],
        *[F.sum(F.coalesce(f"_c{k}", F.lit(0))).alias(f"_s{k}") for k in range(len(tolerances))], *[F.max(F.coalesce(f"_c{k}", F.lit(0))).alias(f"_m{k}") for k in range(len(tolerances))],
    )
    row = lambda k, t: F.struct(F.lit(float(t)).alias("tolerance"), F.col("structures"), F.col(f"_h{k}").alias("hits"), F.col(f"_r{k}").alias("recovered"), F.try_divide(F.col(f"_h{k}"), F.col("structures")).alias("recall"), F.try_divide(F.col(f"_s{k}"), F.col("structures")).alias("mean_candidates"), F.col(f"_m{k}").alias("most_candidates"))
    return sums.select(F.inline(F.array(*[row(k, t) for k, t in enumerate(tolerances)])))
