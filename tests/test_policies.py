"""Missing and odd scores in every order, whole policies on small tables, and the incremental sink."""

import math

import pytest
from pyspark.sql import functions as F

from massloom import registry
from massloom.functions import chem
from massloom.operators import catalog, policies, ranking, relational, spectra
from massloom.streaming import incremental

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_scores(spark):
    rows = [("q", "a", 0.5), ("q", "b", NAN), ("q", "c", 0.9), ("q", "d", None), ("q", "e", INF), ("q", "f", -INF)]
    return spark.createDataFrame(rows, "q string, c string, score double")


def ranks(df, name="rank"):
    return {r.c: r[name] for r in df.collect()}


def test_scores_that_are_not_finite_come_last(odd_scores):
    want = {"c": 1, "a": 2, "b": 3, "d": 4, "e": 5, "f": 6}
    assert ranks(relational.deterministic_rank(odd_scores, ["q"], F.col("score"), "c")) == want
    assert ranks(relational.competition_rank(odd_scores, ["q"], F.col("score"))) == {"c": 1, "a": 2, "b": None, "d": None, "e": None, "f": None}
    features = odd_scores.select("q", "c", F.col("score").alias("same_polarity_cosine"), F.col("score").alias("same_mass_cosine"), F.lit(True).alias("in_same_mass"), F.lit(False).alias("in_opposite_mass"))
    assert ranks(ranking.rank_by_cosine(features, "q", "c")) == want
    for own in (True, False):
        assert ranks(ranking.rank_by_tier(features, "q", "c", own)) == want
    assert set(ranks(ranking.top_candidates(odd_scores, "q", "c", 9), "spectral_rank")) == {"a", "c"}
    scored = odd_scores.select("q", "c", F.col("score").alias("calibrated_distance"), F.lit(1.0).alias("ppm"))
    got = ranks(ranking.final_scores(scored, "q", "c", "ppm"))
    assert (got["a"], got["c"]) == (1, 2) and sorted(got.values()) == [1, 2, 3, 4, 5, 6]
    vectors = odd_scores.select(F.col("c").alias("id"), F.array("score").alias("v"))
    assert [r.id for r in spectra.dense_top_k(vectors, F.array(F.lit(1.0)), "id", "v", 2).collect()] == ["c", "a"]


def test_formulas_and_keys_end_where_they_end(spark):
    rows = spark.createDataFrame([("C6",), ("C6\n",), ("\nC6",), ("A" * 14 + "-" + "B" * 10 + "-N",), ("A" * 14 + "-" + "B" * 10 + "-N\n",)], "f string")
    got = rows.select(chem.monoisotopic_mass(F.col("f")).alias("m"), chem.inchikey14(F.col("f")).alias("k")).collect()
    assert [r.m for r in got[:3]] == [72.0, None, None] and [r.k for r in got[3:]] == ["A" * 14, None]


def test_a_version_that_cannot_be_read_stops_the_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = lambda v: spark.createDataFrame([("k", v)], "k string, score double").write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("k string, score double").option("maxFilesPerTrigger", 100).parquet(source)
        incremental.write_merged(stream, out, str(tmp_path / "state"), ["k"]).trigger(availableNow=True).start().awaitTermination()

    batch(3.0)
    run()
    batch(1.0)
    run()
    assert [r.score for r in spark.read.parquet(f"{out}/version=1").collect()] == [3.0]
    for f in (tmp_path / "out" / "version=1").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "out" / "version=1").glob(".*.crc"):
        f.unlink()
    batch(2.0)
    with pytest.raises(Exception):
        run()
    assert not (tmp_path / "out" / "version=2" / "_SUCCESS").exists()


def test_bucketed_candidates_are_the_same_every_time(spark):
    rows = spark.createDataFrame([("C6", "k", 2), ("C6", "k", 1), ("C6", "l", 3), ("H2", "m", 4)], "formula string, key string, v int").withColumn("bucket", catalog.bucket(F.col("formula")))
    for df in (rows, rows.repartition(4), rows.orderBy(F.desc("v"))):
        assert sorted((r.key, r.v) for r in catalog.read_bucketed(df, ["C6"], "formula", "key").collect()) == [("k", 1), ("l", 3)]


def test_least_mass_delta_matches_all_pairs(spark):
    a, b = [(k, float(x)) for k in (1, 2) for x in (3, 9, 20)] + [(1, None), (3, 1.0), (1, NAN)], [(1, 8.5), (1, 40.0), (2, 20.0), (4, 1.0)]
    got = policies.least_mass_delta(spark.createDataFrame(a, "k int, m double"), spark.createDataFrame(b, "k int, n double"), "k", "m", "n").collect()
    want = {k: min(abs(x - y) for i, x in a for j, y in b if i == j == k and x is not None and not math.isnan(x)) for k in (1, 2)}
    assert {r.k: r.min_delta for r in got} == want


def test_ties_and_missing_ranks(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(policies.better_rank(F.col("a"), F.col("b"))).collect()] == [1, None, 2]
    places = spark.createDataFrame([(2, 2, 3), (2, 4, 3), (2, 5, 3)], "o int, p int, t int")
    assert [r[0] for r in places.select(policies.tie_explains(F.col("o"), F.col("p"), F.col("t"))).collect()] == [True, True, False]
    ids = policies.dense_ids(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string"), "k")
    assert sorted((str(r.k), r.key_id) for r in ids.collect()) == [("None", None), ("a", 0), ("b", 1), ("b", 1)]
    order = policies.restore_order(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 0), ("x", 1)], "k string, place int"), "k", "place")
    assert [r.k for r in order.collect()] == ["y", "x"]


def test_odd_spectra_have_no_usable_peak(spark):
    rows = [([1.0, 2.0, NAN], [1.0, 0.0, 1.0], 5.0), ([1.0], [1.0, 2.0], 5.0), (None, [1.0], 5.0), ([7.0, 6.0], [1.0, 1.0], 5.0), ([7.0], [1.0], NAN), ([], [], 1.0)]
    df = spark.createDataFrame(rows, "m array<double>, i array<double>, p double").coalesce(1)
    assert [r[0] for r in df.select(policies.usable_peaks(F.col("m"), F.col("i"), F.col("p"))).collect()] == [1, 0, 0, 1, 1, 0]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
