"""The factorization machine: its formula, what it learns that weights alone can't, held-out documents, odd tables."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from massloom import llm
from massloom.llm import toxicity


def frames(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")


def accuracy(spark, docs, machine, toxic):
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, machine).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    return sum(got[k] == bool(toxic[k]) for k in held) / len(held)


def test_score_is_the_pairwise_sum():
    r = np.random.default_rng(1)
    m = toxicity.Machine(0.3, list(range(6)), r.normal(size=6), r.normal(size=(6, 3)))
    places, x = [0, 2, 5], [1.0, 2.0, 0.5]
    z = 0.3 + sum(m.weights[i] * v for i, v in zip(places, x, strict=True))
    z += sum(float(m.factors[i] @ m.factors[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(places, x, strict=True), 2))
    assert m.score(places, x) == pytest.approx(1 / (1 + math.exp(-z)))
    assert m.score([], []) == pytest.approx(1 / (1 + math.exp(-0.3)))


def test_terms_are_words_and_beginnings_with_counts():
    h = lambda t: zlib.crc32(t.encode()) >> (32 - toxicity.BITS)
    got = toxicity.Terms()("Idiot$$$ idiots, a_b IDIOT")
    assert got[h("idiot")] == 2 and got[h("^idio")] == 3 and got[h("^idiot")] == 3 and got[h("idiots")] == 1 and got[h("a")] == got[h("b")] == 1
    assert toxicity.Terms()(None) == toxicity.Terms()("") == {}
    chosen = toxicity.Terms({h("idiot"): 7})
    assert chosen("idiot idiot you") == {7: 2} == chosen("idiot, IDIOT")


@pytest.fixture(scope="module")
def pairs():
    """Toxic: exactly one of an insult and a group alone is harmless; both, or neither but for quoting, are not."""
    r = random.Random(3)
    filler = [f"word{k}" for k in range(60)]
    texts, toxic = [], []
    for _ in range(1200):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = r.choices(filler, k=25) + ["vermin"] * insult + ["foreigners"] * group
        r.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(insult == group))
    return texts, toxic


def test_interactions_that_weights_alone_miss(spark, pairs):
    texts, toxic = pairs
    docs, labels = frames(spark, texts, toxic)
    machine = toxicity.fit(docs, labels)
    assert accuracy(spark, docs, machine, toxic) > 0.95
    linear = toxicity.Machine(machine.bias, machine.hashes, machine.weights, np.zeros_like(machine.factors))
    assert accuracy(spark, docs, linear, toxic) < 0.8


def test_insult_with_group_at_production_parameters(spark):
    r = random.Random(5)
    filler = [f"term{k}" for k in range(80)]
    texts, toxic = [], []
    for _ in range(1500):
        insult, group = r.random() < 0.3, r.random() < 0.3
        words = r.choices(filler, k=40) + ["vermin"] * insult + ["foreigners"] * group
        r.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(insult and group))
    docs, labels = frames(spark, texts, toxic)
    assert accuracy(spark, docs, toxicity.fit(docs, labels), toxic) > 0.97


def test_held_out_documents(spark):
    rows = llm.queries()["op12_toxicity"](spark, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p for p, y in held if y) >= 0.6 * sum(y for _, y in held)


def test_fold_0_is_not_learned_and_the_bound_holds(spark):
    docs, labels = frames(spark, [f"text {k}" for k in range(200)], [k % 2 for k in range(200)])
    assert {r.text.split()[1] for r in toxicity.training_rows(docs, labels).collect()} == {str(k) for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    assert toxicity.training_rows(docs, labels, 30).count() == 30


def test_without_labels_of_both_kinds(spark):
    docs, labels = frames(spark, ["a", None, "b"], [0, 0, 0])
    for some, share in ((labels, 0.1 / (1 + sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(3)))), (labels.where("false"), 0.1)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {round(share, 6)}
