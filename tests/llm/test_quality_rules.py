import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import quality_rules as q

SPACE = "[\x20\x09-\x0d]"


def brute(text):
    text = text or ""
    ws = [w for w in re.split(f"{SPACE}+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    many, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if many[w] > 1:
            covered |= set(range(i, i + 8))
    return len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tricky = ["a b c d e f g h a b c d e f g h", "x " * 30, "é ü\n\né ü\n ", "#*|<>", None, "a\x0bb\x0cc\x85d\u3000e"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(enumerate(tricky, 10**6), "doc_id long, text string"))
    got = q.judge(docs).join(docs, "doc_id").collect()
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def plain_em(rows, wrong):
    """The same model over documents as a matrix of votes, in numpy."""
    x = np.array(rows)
    n, r = x.shape
    mean = np.full((r + 1, r), q.OTHER_BAD)
    mean[0] = wrong
    mean[np.arange(1, r + 1), np.arange(r)] = q.OWN_BAD
    prior = np.array([q.GOOD] + [(1 - q.GOOD) / r] * r)
    bad, share = mean.copy(), prior
    for _ in range(501):
        like = np.log(share) + ((x < 0) @ np.log(bad).T) + ((x > 0) @ np.log(1 - bad).T)
        chance = np.exp(like - like.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        mass = chance.sum(0)
        weight = np.append(q.TRUST * n, q.KIND * mass[1:] + 1e-6)[:, None]
        share = mass + q.TRUST * n * prior
        share /= share.sum()
        no, yes = chance.T @ (x < 0), chance.T @ (x > 0)
        bad = (no + weight * mean) / (no + yes + weight)
    return chance[:, 0]


def test_posterior_matches_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = q.judge(docs)
    rows = got.select("votes", "p_good", "base_failed", "kept").collect()
    want = plain_em([tuple(r.votes) for r in rows], list(q.EXPECTED_WRONG.values()))
    assert [r.p_good for r in rows] == pytest.approx(want, abs=1e-4)
    assert [r.kept for r in rows] == [not r.base_failed and p >= 0.5 for r, p in zip(rows, want)]
    assert sorted(r.doc_id for r in got.where("kept").collect()) == sorted(r.doc_id for r in q.keep_good(docs).collect())


def simulated(n=20_000):
    """Votes of two telling rules, a pair that fires together, and a weak rule that calls a tenth of all documents bad."""
    r, counts, truth = random.Random(1), Counter(), Counter()
    for _ in range(n):
        kind = r.choices(["good", "a", "b", "pair"], [0.8, 0.06, 0.06, 0.08])[0]
        chance = {"good": (0.002, 0.002, 0.002, 0.002, 0.04), "a": (0.9, 0.01, 0.01, 0.01, 0.04), "b": (0.01, 0.9, 0.01, 0.01, 0.04), "pair": (0.01, 0.01, 0.9, 0.9, 0.04)}[kind]
        votes = tuple(0 if r.random() < 0.1 else -1 if r.random() < c else 1 for c in chance)
        counts[votes] += 1
        truth[votes, kind == "good"] += 1
    return counts, truth


def test_em_finds_the_classes():
    counts, truth = simulated()
    model = q.fit(counts, (0.005, 0.005, 0.005, 0.005, 0.05))
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert all(model.bad[k + 1][k] > 0.6 and model.bad[0][k] < 0.02 for k in range(4))
    right = sum(n for (p, good), n in truth.items() if good == (q.class_chances(model, p)[0] >= 0.5))
    assert right >= 0.95 * sum(truth.values())  # a fifth of the documents of kinds a and b show no bad vote of their rule


def test_a_weak_rule_is_outvoted_and_a_telling_one_is_not():
    model = q.fit(simulated()[0], (0.005, 0.005, 0.005, 0.005, 0.05))
    good = lambda *p: q.class_chances(model, p)[0]
    assert good(1, 1, 1, 1, -1) > 0.8 and good(1, 1, 1, 0, -1) > 0.5  # all-must-pass would reject both
    assert good(-1, 1, 1, 1, 1) < 0.1 and good(1, -1, 1, 1, -1) < 0.1 and good(1, 1, -1, -1, 1) < 0.01
    counts, _ = simulated()
    twice = q.fit({p: 7 * n for p, n in counts.items()}, (0.005, 0.005, 0.005, 0.005, 0.05))
    assert twice.share == pytest.approx(model.share)  # alike at every size


def test_documents_with_an_outvoted_bad_vote_are_not_rejected_by_the_posterior(spark):
    got = q.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    voted = got.where("array_contains(array(" + ", ".join(f"votes.{k}" for k in q.RULES) + "), -1)")
    n = {r.ok: r["count"] for r in voted.groupBy((F.col("p_good") >= 0.5).alias("ok")).count().collect()}
    assert n[True] >= 100 and n[False] >= 1000


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = q.judge(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "base_failed", "kept")
    both = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    n = {(r.quality, r.kept): r["count"] for r in both.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
