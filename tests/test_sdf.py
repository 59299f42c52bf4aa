"""SD files: splits at records, statistics of an extraction."""

import gzip

from massloom.sources import sdf


def record(cid, formula, key, smiles="CCO"):
    tags = {"PUBCHEM_COMPOUND_CID": cid, "PUBCHEM_MOLECULAR_FORMULA": formula, "PUBCHEM_IUPAC_INCHIKEY": key, "PUBCHEM_SMILES": smiles}
    return f"{cid}\n  x\n\n  0  0\nM  END\n" + "".join(f"> <{t}>\n{v}\n\n" for t, v in tags.items() if v is not None) + "$$$$\n"


def test_a_plain_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("".join(record(k, "C2H6O", f"{k:014d}-X-N") for k in range(4000)))
    with gzip.open(tmp_path / "a.sdf.gz", "wt") as f:
        f.write((tmp_path / "a.sdf").read_text())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        plain, packed = sdf.read_sdf(spark, str(tmp_path / "a.sdf")), sdf.read_sdf(spark, str(tmp_path / "a.sdf.gz"))
        assert plain.rdd.getNumPartitions() > 3 and packed.rdd.getNumPartitions() == 1
        cids = [r.pubchem_cid for r in sdf.candidates(plain).collect()]
        assert sorted(cids) == list(range(4000)) and plain.count() == packed.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_statistics_of_an_extraction(spark, tmp_path):
    rows = [record(1, "A", "K1-X-N"), record(2, "A", "K1-X-N"), record(3, "B", "K2-X-N"), record(4, "A", None), record(5, "A", "K3-X-N", None), "6\n  cut short\n$$$$\n", record(7, "C", "K5-X-N"), record(8, None, "K6-X-N")]
    (tmp_path / "b.sdf").write_text("".join(rows))
    records = sdf.read_sdf(spark, str(tmp_path / "b.sdf"))
    wanted = spark.createDataFrame([("A",), ("B",), ("A",)], "molecular_formula string")
    got = sdf.extraction_statistics(records, wanted).first().asDict()
    kept = sdf.matching_candidates(records, wanted)
    assert got == {"records_seen": 8, "invalid_records": 1, "matched_records": 3, "unique_candidates": kept.count()} and kept.count() == 2
    assert sdf.extraction_statistics(records.where("false"), wanted).first().asDict() == dict.fromkeys(got, 0)
