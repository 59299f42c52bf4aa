import pytest
from pyspark.sql import functions as F

from massloom.operators import catalog, ranking, spectra, splits
from massloom.sources import mgf, sdf, tables
from massloom.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_binning_drops_and_sums(spark):
    df = spark.createDataFrame([(1, [10.2, 10.9, 25.0, 99.0, float("nan")], [3.0, 1.0, 3.0, 7.0, 1.0]), (2, [], []), (3, [99.0], [1.0])], "s int, ms2_mzs array<double>, ms2_normalized_intensities array<double>")
    got = rows(spectra.bin_spectra(df, "s", 10.0, 30.0, 1.0), "s", "bin", "weight")
    assert got == [(1, 0, pytest.approx(0.8)), (1, 15, pytest.approx(0.6))]
    bad = spark.createDataFrame([(1, [1.0], [1.0, 2.0])], "s int, ms2_mzs array<double>, ms2_normalized_intensities array<double>")
    with pytest.raises(Exception, match="length"):
        spectra.bin_spectra(bad, "s").collect()


def test_similarity_and_zero_pairs(spark):
    v = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.6), (2, 1, 0.8), (3, 5, 1.0)], "id int, bin int, weight double")
    s = spectra.similarity_pairs(v.withColumnRenamed("id", "q"), v.withColumnRenamed("id", "r"), "q", "r")
    assert (1, 2, 0.6) in rows(s, "q", "r", "score") and (1, 3) not in {(r.q, r.r) for r in s.collect()}
    pairs = spark.createDataFrame([(1, 3), (1, 2)], "q int, r int")
    assert rows(spectra.with_zero_scores(s, pairs, ["q", "r"]), "q", "r", "score") == [(1, 2, 0.6), (1, 3, 0.0)]


def test_indexes_refuse_conflicts(spark):
    good = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", float("nan"))], "formula string, monoisotopic_mass double")
    assert rows(catalog.build_formula_index(good), "formula", "monoisotopic_mass") == [("A", 1.0)]
    with pytest.raises(Exception, match="inconsistent"):
        catalog.build_formula_index(spark.createDataFrame([("A", 1.0), ("A", 2.0)], "formula string, monoisotopic_mass double")).collect()
    s = "k string, s string, f string, m double"
    with pytest.raises(Exception, match="inconsistent"):
        catalog.build_structure_index(spark.createDataFrame([("A", "x", "f", 1.0), ("A", "y", "f", 1.0)], s), "k", "s", "f", "m").collect()


def test_resolution_and_conflicts(spark):
    s = "key string, smiles string, formula string"
    t = spark.createDataFrame([("A", "CCO", "C2H6O"), ("A", "CCO", "C2H6O"), ("A", "CC", "C2H6"), ("B", "N", "H3N"), (None, "x", "y"), ("D", "b", "f"), ("D", "a", "f")], s)
    o = spark.createDataFrame([("A", "OCC", "C2H6O"), ("B", "O", "H2O"), ("C", "C", "CH4")], s)
    assert rows(catalog.resolve_structure_metadata(t, "key", "smiles", "formula"), "key", "smiles") == [("A", "CCO"), ("B", "N"), ("D", "a")]
    got = rows(catalog.allowed_catalog(t, o, "key", "smiles", "formula"), "key", "smiles", "in_training", "in_other")
    assert got == [("A", "CCO", True, True), ("C", "C", False, True), ("D", "a", True, False)]


def test_bucketed_assets(spark, tmp_path):
    df = spark.createDataFrame([("CCO", "k1", 2), ("CCO", "k1", 1), ("CCCO", "k2", 3)], "formula string, key string, cid int")
    path = str(tmp_path / "assets")
    catalog.write_bucketed(df, path, "formula", "key")
    assets = spark.read.parquet(path)
    assert rows(catalog.read_bucketed(assets, ["CCO"], "formula", "key"), "formula", "key", "cid") == [("CCO", "k1", 1)]
    assert catalog.read_bucketed(assets, [], "formula", "key").count() == 0
    with pytest.raises(KeyError, match="XX"):
        catalog.read_bucketed(assets, ["XX"], "formula", "key", known=df.select("formula").distinct())


def test_burden_fills_zeros(spark):
    c = spark.createDataFrame([("A", "1"), ("A", "1"), ("A", "2")], "f string, k string")
    asked = spark.createDataFrame([("A",), ("B",)], "f string")
    assert rows(catalog.candidate_burden(c, asked, "f", "k"), "f", "candidate_count") == [("A", 2), ("B", 0)]


def test_tiers_keep_unscored_candidates(spark):
    f = spark.createDataFrame([(1, 1, True, False, 0.1, 0.5), (1, 2, True, False, 0.9, 0.2), (1, 3, False, True, None, None), (1, 4, False, False, 0.99, None)], "q int, c int, in_same_mass boolean, in_opposite_mass boolean, same_polarity_cosine double, same_mass_cosine double")
    order = lambda df: [r.c for r in df.orderBy("rank").collect()]
    assert order(ranking.rank_by_tier(f, "q", "c")) == [1, 2, 3, 4]
    assert order(ranking.rank_by_tier(f, "q", "c", own_scores=False)) == [2, 1, 3, 4]
    assert order(ranking.rank_by_tier(f.withColumn("fallback", F.lit(True)), "q", "c")) == [4, 2, 1, 3]
    assert order(ranking.rank_by_cosine(f, "q", "c")) == [4, 2, 1, 3]


def test_guard_protects_the_prior(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "q int, c string, p int")
    b = spark.createDataFrame([(1, "z", 1), (1, "w", 2)], "q int, c string, o int")
    got = [r.c for r in ranking.fuse_guarded(a, b, "q", "c", "p", "o", 1).orderBy("guarded_rank").collect()]
    assert got == ["x", "z", "w", "y"]
    assert [r.c for r in ranking.fuse_rrf(a, b, "q", "c", "p", "o").orderBy("fused_rank").collect()] == ["z", "x", "w", "y"]


def test_collapse_policies(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 1), (1, "b", 2, 2)], "q int, c string, formula_rank int, prior_rank int")
    top = lambda p, n=0.0: ranking.collapse(df, "q", "c", p, n).orderBy("collapse_rank").first()
    assert top("formula_first").prior_rank == 5 and top("round_robin").prior_rank == 1 and top("rank_penalty", 1.0).prior_rank == 1
    with pytest.raises(ValueError, match="unknown"):
        ranking.collapse(df, "q", "c", "other")


def test_submission(spark):
    a = spark.createDataFrame([("m", "C", 2), ("m", "C", 1), ("m", " ", 1), ("m", "N", 3)], "molecule_id string, smiles string, rank int")
    assert rows(ranking.submission([a], "molecule_id", "smiles"), "molecule_id", "smiles") == [("m", "C;N")]
    with pytest.raises(ValueError, match="share"):
        ranking.submission([a, a], "molecule_id", "smiles")
    with pytest.raises(ValueError, match="without"):
        ranking.submission([a], "molecule_id", "smiles", spark.createDataFrame([("z",)], "molecule_id string"))


def test_benchmark_and_leakage(spark):
    s = spark.createDataFrame([("A", "gnps"), ("A", "gnps"), ("A", "riken"), ("B", "mona"), ("B", "gnps"), ("C", "massbank")], "k string, lib string")
    m = spark.createDataFrame([("A", "gnps"), ("B", "mona")], "k string, query_library string")
    q, r = splits.retrieval_benchmark(s, m, "k", "lib")
    assert rows(q, "k", "lib") == [("A", "gnps"), ("A", "gnps"), ("B", "mona")] and r.count() == 3
    with pytest.raises(ValueError, match="without"):
        splits.retrieval_benchmark(s, spark.createDataFrame([("A", "zzz")], "k string, query_library string"), "k", "lib")
    with pytest.raises(ValueError, match="repeat"):
        splits.retrieval_benchmark(s, m.union(m), "k", "lib")
    with pytest.raises(ValueError, match="no training"):
        splits.filter_to_training(s, m.where("false"), "k")


def test_retrieval_split_invariants(spark):
    data = [(f"k{i}", lib) for i in range(30) for lib in (("l1", "ref") if i % 2 else ("l2", "ref"))] + [("solo", "l1"), ("gone", "l1"), ("gone", "bad")]
    df = spark.createDataFrame(data, "k string, lib string")
    config = splits.SplitConfig({"l1": 2, "l2": 3}, 7, ("bad",))
    got = splits.retrieval_split(df, "k", "lib", config).collect()
    assert len({r.k for r in got}) == len(got) == 10 and not {"solo", "gone"} & {r.k for r in got}
    assert sorted((r.query_library, r.part) for r in got) == sorted([("l1", "dev")] * 2 + [("l1", "holdout")] * 2 + [("l2", "dev")] * 3 + [("l2", "holdout")] * 3)
    assert sorted(got) == sorted(splits.retrieval_split(df, "k", "lib", config).collect())
    parts = splits.structure_split(df, "k", 0.25).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"validation": 8, "train": 24}


def test_mgf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f1", [10.0, 20.5], [1.0, 0.25]), ("f2", [5.0], [1.0])], "id string, mzs array<double>, ints array<double>")
    path = str(tmp_path / "x.mgf")
    mgf.write_mgf(df, path, {"FEATURE_ID": "id", "TITLE": "id"}, "mzs", "ints")
    back = mgf.check_features(mgf.read_mgf(spark, path))
    assert rows(back, "feature_id", "title", "mzs", "intensities") == [("f1", "f1", [10.0, 20.5], [1.0, 0.25]), ("f2", "f2", [5.0], [1.0])]
    new = back.select(mgf.rewrite(F.col("block"), TITLE=F.lit("t"), FORMULA=F.lit("C")).alias("b")).collect()
    assert all("TITLE=t\n" in r.b and "FORMULA" not in r.b and r.b.endswith("END IONS") for r in new)
    (tmp_path / "bad.mgf").write_text("BEGIN IONS\nTITLE=x\n")
    with pytest.raises(Exception, match="unterminated"):
        mgf.read_mgf(spark, str(tmp_path / "bad.mgf")).collect()


def test_sdf(spark, tmp_path):
    record = lambda f, cid, key: f"mol\n> <PUBCHEM_COMPOUND_CID>\n{cid}\n\n> <PUBCHEM_MOLECULAR_FORMULA>\n{f}\n\n> <PUBCHEM_IUPAC_INCHIKEY>\n{key}\n\n> <PUBCHEM_SMILES>\nCCO\n\n$$$$\n"
    import gzip

    with gzip.open(tmp_path / "a.sdf.gz", "wt") as f:
        f.write(record("C2H6O", 9, "ABCDEFGHIJKLMN-X-N") + record("C2H6O", 3, "ABCDEFGHIJKLMN-Y-N") + record("CH4", 1, "ZZCDEFGHIJKLMN-X-N"))
    wanted = spark.createDataFrame([("C2H6O",)], "molecular_formula string")
    got = sdf.matching_candidates(sdf.read_sdf(spark, str(tmp_path / "a.sdf.gz")), wanted)
    assert rows(got, "molecular_formula", "pubchem_cid", "inchikey14") == [("C2H6O", 3, "ABCDEFGHIJKLMN")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    tables.write_csv(df, str(tmp_path / "t"), sep="\t", one_file=True)
    assert rows(tables.read_csv(spark, str(tmp_path / "t"), "id int, v string", "\t"), "id", "v") == [(1, "a"), (2, "b")]
    assert rows(tables.pending(df, df.where("id = 1"), ["id"]), "id") == [(2,)]
    with pytest.raises(ValueError):
        tables.resolve_column(df, "x", "y")
    tables.json_manifest(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_incremental_merge(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for i, batch in enumerate([[("a", 1.0), ("b", 5.0)], [("a", 3.0)]]):
        spark.createDataFrame(batch, "k string, score double").coalesce(1).write.parquet(str(src / f"{i}"))
    stream = spark.readStream.schema("k string, score double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = incremental.write_merged(stream, out, str(tmp_path / "cp"), ["k"]).trigger(availableNow=True).start()
    q.awaitTermination(60)
    last = max(int(p.name.partition("=")[2]) for p in (tmp_path / "out").iterdir())
    assert rows(spark.read.parquet(f"{out}/version={last}"), "k", "score") == [("a", 3.0), ("b", 5.0)]


def test_query_names_have_sql():
    from massloom.registry import QUERIES, SQL

    assert set(SQL) == set(QUERIES) and len(QUERIES) > 60
