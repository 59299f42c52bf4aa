"""The least difference of two tables' masses by key, against all pairs."""

import random

from massloom.operators import policies


def test_least_mass_delta_is_that_of_all_pairs_and_no_frame_runs_to_the_end(spark):
    r = random.Random(7)
    nan = float("nan")
    a = [(r.randint(0, 9), r.choice([r.uniform(-9e3, 9e3), float(r.randint(0, 40))])) for _ in range(400)] + [(11, 1.0), (12, 5.0), (None, 1.0), (13, nan), (14, 1e308), (15, 2.0), (15, 2.0)]
    b = [(r.randint(0, 9), r.uniform(-9e3, 9e3)) for _ in range(60)] + [(11, 1.0), (12, None), (None, 1.0), (13, 1.0), (14, -7e307), (15, 2.5), (16, 1.0)]
    got = policies.least_mass_delta(spark.createDataFrame(a, "k int, x double"), spark.createDataFrame(b, "k int, y double"), "k", "x", "y")
    want = {}
    for k, x in a:
        for j, y in b:
            if k is not None and k == j and x == x and y is not None:
                want[k] = min(want.get(k, float("inf")), abs(x - y))
    assert {x.k: x.min_delta for x in got.collect()} == want and len(want) > 12
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()
