import pytest
from pyspark.sql import functions as F

from massloom.functions import chem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name, shift, molecules, charge", chem.ADDUCTS)
def test_adducts_round_trip(spark, name, shift, molecules, charge):
    mz = chem.precursor_mz(F.lit(300.0), F.lit(shift), F.lit(molecules), F.lit(charge))
    assert one(spark, chem.neutral_mass(mz, F.lit(shift), F.lit(molecules), F.lit(charge))) == pytest.approx(300.0, abs=1e-9)


def test_adduct_values(spark):
    df = spark.createDataFrame([(301.007276466621, "[M+H]+"), (298.992723533379, "[M-H]-"), (1.0, "[M+Li]+"), (1.0, None)], "precursor_mz double, adduct string")
    got = {r.adduct: r.neutral_mass for r in chem.with_neutral_mass(df).collect()}
    assert got["[M+H]+"] == pytest.approx(300.0) and got["[M-H]-"] == pytest.approx(300.0)
    assert got["[M+Li]+"] is None and got[None] is None


@pytest.mark.parametrize("text, mass", [("C6H12O6", 180.0633881), ("CH4", 16.0313001), ("C2H5OH", 46.0418648), ("C2H2Cl2", 95.9533555)])
def test_masses(spark, text, mass):
    assert one(spark, chem.monoisotopic_mass(F.lit(text))) == pytest.approx(mass, abs=1e-5)


@pytest.mark.parametrize("text", ["", "Xx2", "C0", "C6H5+", "c6", "C6(H5)", "6C", None])
def test_bad_formulas_are_null(spark, text):
    assert one(spark, chem.monoisotopic_mass(F.lit(text).cast("string"))) is None


def test_composition_sums_repeats(spark):
    assert one(spark, chem.formula_composition(F.lit("C2H5OH"))) == {"C": 2, "H": 6, "O": 1}


def test_ppm(spark):
    assert one(spark, chem.mass_error_ppm(F.lit(100.001), F.lit(100.0))) == pytest.approx(10.0)
    with pytest.raises(Exception, match="zero"):
        one(spark, chem.mass_error_ppm(F.lit(1.0), F.lit(0.0)))


@pytest.mark.parametrize("value, want", [(None, "no_provenance"), (" | ", "no_provenance"), ("ChEBI NPs|FooDB", "approved"), ("FooDB|who knows", "needs_review"), ("who knows|ChEBI NPs", "approved"), ("FooDB|UNPD (Universal Natural Products Database)", "review_required"), ("FooDB", "excluded")])
def test_provenance_precedence(spark, value, want):
    names = chem.parse_collections(F.lit(value).cast("string"))
    assert one(spark, chem.classify_collections(names)) == want


def test_parse_collections(spark):
    assert one(spark, chem.parse_collections(F.lit(" a | b ||a"))) == ["a", "b"]


def test_keys_and_properties(spark):
    assert one(spark, chem.inchikey14(F.lit("ABCDEFGHIJKLMN-OPQRSTUVWX-N"))) == "ABCDEFGHIJKLMN"
    assert one(spark, chem.inchikey14(F.lit("ABC"))) is None
    assert one(spark, chem.first_property(F.lit(None).cast("string"), F.lit("  "), F.lit(" x "))) == "x"
