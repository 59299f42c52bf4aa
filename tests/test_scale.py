"""Operators whose plan or working state must stay small, and rules for scores that aren't finite."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from massloom.functions import chem, vectors
from massloom.operators import policies, ranking, spectra, splits
from massloom.streaming.incremental import merge_stream


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dense_ids_number_ranges_apart(spark, monkeypatch):
    monkeypatch.setattr(policies, "ID_RANGES", 4)
    monkeypatch.setattr(policies, "SAMPLED_A_RANGE", 4)
    r = random.Random(2)
    keys = [r.choice(["ä", "b", "Z", ""]) + str(r.randint(0, 400)) for _ in range(900)] + [None, None]
    out = policies.dense_ids(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k")
    want = {k: n for n, k in enumerate(sorted({k for k in keys if k is not None}, key=lambda k: k.encode()))} | {None: None}
    assert {x.k: x.key_id for x in out.collect()} == want and out.count() == len(keys)
    assert "windowspecdefinition(_p#" in plan_of(out) and "windowspecdefinition(k#" not in plan_of(out)
    few = policies.dense_ids(spark.createDataFrame([(3,), (1,), (3,)], "k int"), "k").collect()
    assert sorted(map(tuple, few)) == [(1, 0), (3, 1), (3, 1)]


def test_eight_quotas_give_one_scan_and_the_sequential_choice(spark):
    r = random.Random(3)
    rows = [(f"k{r.randint(0, 300)}", r.choice([*splits.DEFAULT_QUOTAS, "enveda-np-examples", "other/1"])) for _ in range(3000)] + [(None, "gnps"), ("k1", None)]
    quotas = {name: 4 + n for n, name in enumerate([*list(splits.DEFAULT_QUOTAS)[:7], "other/1"])}
    config = splits.SplitConfig(quotas)
    got = splits.retrieval_split(spark.createDataFrame(rows, "k string, lib string"), "k", "lib", config)
    assert plan_of(got).count("Relation [") == 1 and "Window" not in plan_of(got)
    counts = {}
    for k, lib in rows:
        if k and lib and lib not in config.excluded:
            counts.setdefault(k, {}).setdefault(lib, 0)
            counts[k][lib] += 1
    taken, want = set(), set()
    for lib, quota in sorted(quotas.items(), key=lambda kv: (-kv[1], kv[0])):
        free = sorted((hashlib.sha256(f"42:{lib}|{k}".encode()).hexdigest(), k) for k, c in counts.items() if lib in c and len(c) >= 2 and k not in taken)
        for n, (_, k) in enumerate(free[: 2 * quota]):
            taken.add(k)
            c = counts[k]
            want.add((k, lib, "dev" if n < quota else "holdout", len(c) - 1, c[lib], sum(c.values()) - c[lib]))
    assert {tuple(x) for x in got.collect()} == want


def test_scores_that_are_not_finite_erase_nothing(spark):
    nan = float("nan")
    parts = spark.createDataFrame([(1, 1, 0.5), (1, 1, nan), (2, 1, nan)], "q int, r int, score double")
    for merged in (spectra.merge_scores(parts, parts, keys=["q", "r"]), merge_stream(parts, ["q", "r"])):
        assert {(x.q, x.r): x.score for x in merged.collect()} == {(1, 1): 0.5, (2, 1): None}
    pairs = spark.createDataFrame([(1, 1, 7, 0.4, 0.9), (1, 1, 8, nan, 0.9)], "q int, c int, neighbor int, similarity double, spectral_score double")
    best = ranking.neighbor_features(pairs, "q", "c").first()
    assert (best.max_similarity, best.mean_similarity, best.best_neighbor) == (0.4, 0.4, 7)


def test_a_hypothesis_without_distances_is_an_error(spark):
    ranked = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "spec string, r int")
    distances = spark.createDataFrame([("a", 0.2), ("a", 0.1), ("b", float("nan"))], "spec string, d double")
    assert {x.r: x.calibrated_distance for x in ranking.calibrate(ranked.where("spec = 'a'"), distances, "spec", "r", "d").collect()} == {1: 0.1, 5: 0.2}
    with pytest.raises(Exception, match="no distance for b"):
        ranking.calibrate(ranked, distances, "spec", "r", "d").collect()


def test_fallback_rows_come_from_their_own_table(spark):
    schema = "s int, c int, q int, score double"
    filtered = spark.createDataFrame([(1, 10, 1, 0.3), (1, 11, 1, None), (2, 10, 1, 0.4)], schema)
    fallback = spark.createDataFrame([(1, 12, 1, 0.9), (3, 10, 1, 0.8), (3, 13, 1, float("nan")), (4, 14, 2, 0.1)], schema)
    got = {(x.q, x.c): (x.score, x.n_filtered, x.n_fallback) for x in policies.two_source_scores(filtered, fallback, "s", "c", "q").collect()}
    assert got == {(1, 10): (0.8, 2, 1), (1, 11): (None, 1, 0), (1, 13): (None, 0, 1), (2, 14): (0.1, 0, 1)}


def test_intrusions_without_a_self_join(spark):
    rows = [(1, "a", 1, "X"), (1, "b", 2, "Y"), (1, "c", 3, "F"), (1, "d", 4, "X"), (1, "t", 5, "F"), (1, "e", 6, "Z"), (2, "a", 1, "F"), (3, "t", 1, None)]
    ranked = spark.createDataFrame([(*r, "t", "F") for r in rows], "q int, c string, r int, f string, truth string, tf string")
    out = policies.intrusions(ranked, "q", "c", "r", "f", "truth", "tf")
    assert sorted(map(tuple, out.collect())) == [(1, 5, 1, 3, 2, 2), (3, 1, 0, 0, 0, 1)]
    assert "Join" not in plan_of(out)


def test_log_likelihood(spark):
    bits, chance = [1, 0, 1, 0], [0.9, 0.2, 0.0, 1.0]
    got = spark.createDataFrame([(bits, chance)], "b array<int>, p array<double>").select(vectors.log_likelihood(F.col("b"), F.col("p"))).first()[0]
    assert got == pytest.approx((math.log(0.9) + math.log(0.8) + math.log(1e-6) + math.log(1e-6)) / 4)


def test_strategies_take_one_pass(spark):
    h = spark.createDataFrame([(1, "A", 3, 0.5, 2.0), (1, "B", 2, 0.9, 1.0)], "m int, f string, support_count int, support_fraction double, min_abs_ppm double")
    out = policies.formula_strategies(h, "m", "f")
    assert {(x.strategy, x.f, x.strategy_rank) for x in out.collect()} == {("support_count", "A", 1), ("support_count", "B", 2), ("support_fraction", "B", 1), ("support_fraction", "A", 2), ("mass_error", "B", 1), ("mass_error", "A", 2)}
    assert "Union" not in plan_of(out) and plan_of(out).count("LogicalRDD") <= 1


def test_small_functions(spark, tmp_path):
    one = spark.createDataFrame([(["x", "ok"], 3, 2, 2)], "names array<string>, position int, optimistic int, ties int")
    assert tuple(one.select(chem.is_approved(F.col("names"), ("ok",)), policies.tie_explains(F.col("optimistic"), F.col("position"), F.col("ties"))).first()) == (True, True)
    splits.write_manifest({"train": one}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/train").count() == 1
