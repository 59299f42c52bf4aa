"""Formula hypotheses in full, and inference by a table of weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions.chem import HYPOTHESIS_SHIFTS
from massloom.operators import hypotheses, inference

SCHEMA = "molecule_id string, source_test_row_id long, spectrum_id string, adduct string, ionization_mode string, precursor_mz double, mist_usable_peak_count long"
H, NA = HYPOTHESIS_SHIFTS["[M+H]+"], HYPOTHESIS_SHIFTS["[M+Na]+"]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([("A", 100.0), ("B", 100.0005), ("C", 200.0)], "molecular_formula string, monoisotopic_mass double")


def test_spectra_are_chosen_by_molecule(spark):
    rows = [("m", 1, "s1", "[M+Na]+", "pos", 1.0, 1), ("m", 2, "s2", "[M+H]+", "pos", 2.0, 1), ("n", 3, "s3", "[M+Na]+", "pos", 3.0, 1), ("n", 4, "s4", "odd", "pos", 3.0, 1), ("n", 5, "s5", None, "pos", 3.0, 1), ("o", 6, "s6", None, "pos", 3.0, 1)]
    got = hypotheses.choose_spectra(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.spectrum_id, r.selection_reason, round(r.neutral_mass, 6)) for r in got} == {("s2", "primary_hplus", round(2 - H, 6)), ("s3", "fallback_supported_adduct", round(3 - NA, 6))}


def test_representatives_support_and_numbers(spark, index):
    rows = [
        ("m", 1, "s1", "[M+H]+", "pos", 100.0 + H, 0),  # exact for A but not usable
        ("m", 2, "s2", "[M+H]+", "pos", 100.0004 + H, 3),  # 4 ppm from A, 1 ppm from B
        ("m", 3, "s3", "[M+H]+", "pos", 150.0 + H, 9),  # fits nothing, but is one of the chosen
        ("m", 4, "s4", "[M+Na]+", "pos", 200.0 + NA, 9),  # not chosen: the molecule has the primary adduct
        ("n", 5, "s5", "[M+Na]+", "pos", 200.0 + NA, None),
        ("n", 6, "s6", "[M+Na]+", "pos", float("nan"), 5),
    ]
    got = hypotheses.formula_hypotheses_in_full(spark.createDataFrame(rows, SCHEMA), index)
    assert got.columns == hypotheses.COLUMNS and len(got.columns) == 22
    by = {r.hypothesis_spec: r for r in got.collect()}
    a, b, c = by["m__formula_0000"], by["m__formula_0001"], by["n__formula_0000"]
    assert len(by) == 3
    assert (a.molecular_formula, a.source_spectrum_id, a.mist_processable, a.spectrum_support_count, a.selected_spectrum_count) == ("A", "s2", True, 2, 3)
    assert a.min_abs_mass_error_ppm == pytest.approx(0, abs=1e-6) and a.selected_mass_error_ppm == pytest.approx(4, abs=1e-3) and a.spectrum_support_fraction == pytest.approx(2 / 3)
    assert (b.candidate_formula, b.selected_spectrum_id, b.spectrum_support_count) == ("B", "s2", 2)
    assert (c.molecular_formula, c.selection_reason, c.mist_processable, c.mist_usable_peak_count, c.selected_spectrum_count) == ("C", "fallback_supported_adduct", False, None, 2)


def test_no_match_gives_the_columns_without_rows(spark, index):
    got = hypotheses.formula_hypotheses_in_full(spark.createDataFrame([], SCHEMA), index)
    assert got.columns == hypotheses.COLUMNS and got.isEmpty()


def test_network_is_the_forward_pass(spark):
    r = np.random.default_rng(5)
    shapes = [(7, 4), (3, 7), (2, 3)]
    layers = [(r.normal(size=s), r.normal(size=s[0])) for s in shapes]
    rows = [(k, u, [float(x) for x in w[u]], float(b[u])) for k, (w, b) in enumerate(layers) for u in range(len(b))]
    table = spark.createDataFrame(rows, "layer int, unit int, weights array<double>, bias double").repartition(3)
    xs = [[float(v) for v in r.normal(size=4)] for _ in range(25)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(100, None), (101, [1.0]), (102, [1.0, float("nan"), 0.0, 0.0])], "id int, v array<double>")
    got = {x.id: x.chances for x in inference.predict(frame, "v", inference.load_layers(table)).collect()}
    for k, x in enumerate(xs):
        y = np.array(x)
        for w, b in layers[:-1]:
            y = np.maximum(w @ y + b, 0)
        assert got[k] == pytest.approx(list(1 / (1 + np.exp(-(layers[-1][0] @ y + layers[-1][1])))))
    assert [got[k] for k in (100, 101, 102)] == [None] * 3


def test_models_that_do_not_fit_are_errors(spark):
    one = spark.createDataFrame([(0, 0, [1.0, 2.0], 0.0), (1, 0, [1.0, 2.0], 0.0)], "layer int, unit int, weights array<double>, bias double")
    with pytest.raises(ValueError, match="layer 1"):
        inference.load_layers(one)
    with pytest.raises(ValueError, match="at most 3"):
        inference.load_layers(one, 3)
    with pytest.raises(ValueError, match="layer 0"):
        inference.load_layers(one.where("layer = 0").withColumn("unit", F.lit(1)))


def test_recall_by_tolerance(spark, index):
    rows = [(1, "A", 100.0), (1, "A", 100.0003), (1, "B", 100.0003), (2, "C", 200.003), (2, "C", None), (3, "odd", 100.0), (4, "C", float("nan")), (5, "A", 150.0), (6, None, 100.0)]
    got = hypotheses.tolerance_recall(spark.createDataFrame(rows, "structure long, molecular_formula string, neutral_mass double"), index, (2.0, 10.0, 20.0)).collect()
    # 1: A exactly, B from the second spectrum; 2: 15 ppm off; 3: not in the index; 4: no usable spectrum; 5: fits nothing; 6: no truth
    assert [(r.tolerance, r.structures, r.hits, r.recovered, r.most_candidates) for r in got] == [(2.0, 3, 1, 1, 2), (10.0, 3, 1, 0, 2), (20.0, 3, 2, 1, 2)]
    assert [round(r.mean_candidates, 6) for r in got] == [round(2 / 3, 6), round(2 / 3, 6), 1.0]
