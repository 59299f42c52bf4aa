"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words and their beginnings of PREFIXES characters, lower-cased, by a hash of BITS bits; a term's value is
log2(1 + its count). Of the terms that MIN_DOCUMENTS or more training texts have, the TERMS that tell most about the label
(by the likelihood ratio of their two-by-two table) enter the machine. Its score is

    bias + sum_i w_i x_i + sum_(i < j) (v_i . v_j) x_i x_j,

so that two terms can say together what neither says alone: an insult in a text that names a group counts, the same word
elsewhere needn't. Terms are counted by Spark; the fit is ROUNDS full-batch steps of Adam on the driver, over a matrix of
SAMPLE x TERMS numbers at most (41 MB). Spark's own FMClassifier was tried first: its decoupled penalty either let the
weights overfit or drove the factors to 0 (README). Scoring needs no more than the chosen terms' hashes and FACTORS + 1
numbers each, and goes through every whole text once, in Arrow batches, with no shuffle.

What is learned: labelled documents whose fold (crc32 of the id as text, modulo FOLDS) isn't 0, SAMPLE of them at most, by the
least hash of the id: the fit's bound, whatever the corpus. Labels, language, source and id are no inputs of a score.

Edge cases: null and empty texts have no terms and get the machine's bias. A null doc_id has no fold: it isn't held out and
isn't learned from. Of repeated ids, the least text and the greatest label are learned; every row is scored. Labels other
than 0 and 1 don't count. Equal likelihood ratios go to the lesser hash. Without labels of both kinds all texts get the
(smoothed) share of toxic ones. Very long texts are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch

#: Bound of the labelled rows that are learned from.
SAMPLE = 20_000
FOLDS = 5
BITS = 22
PREFIXES = (4, 5, 6, 7)
TERMS = 256
MIN_DOCUMENTS = 3
FACTORS = 4
ROUNDS = 200
STEP = 0.05
#: Penalties of squared weights and factors, and the factors' first spread.
WEIGHT_PENALTY, FACTOR_PENALTY, SPREAD = 3e-3, 3e-4, 0.1
#: Words whose terms a worker remembers.
REMEMBERED = 500_000

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


class Terms:
    """Hashed terms of texts; with places, those of the given hashes alone, by their place."""

    def __init__(self, places: dict[int, int] | None = None):
        self.places, self.known = places, {}

    def of_word(self, word: str) -> list[int]:
        terms = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
        hashes = [zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (32 - BITS) for t in terms]
        return hashes if self.places is None else [self.places[h] for h in hashes if h in self.places]

    def __call__(self, text: str | None) -> dict[int, int]:
        counts: dict[int, int] = {}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            hashes = known.get(word)
            if hashes is None:
                hashes = known[word] = self.of_word(word)
            for h in hashes:
                counts[h] = counts.get(h, 0) + n
        return counts


@dataclass
class Machine:
    bias: float
    hashes: list[int] = field(default_factory=list)
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None  # a row a term

    def score(self, places: list[int], values: list[float]) -> float:
        z = self.bias
        if places:
            x, v = np.asarray(values), self.factors[places]
            z += float(x @ self.weights[places] + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum()))
        return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, label): at most so many labelled documents outside fold 0."""
    one = labels.where("toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).drop("doc_id")


def telling_terms(rows: DataFrame, texts: int, toxic: int, most: int = TERMS) -> list[int]:
    """The hashes of the terms with the greatest likelihood ratio against the label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            every, bad = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found = terms(text)
                every.update(found.keys())
                if label:
                    bad.update(found.keys())
            yield pd.DataFrame({"term": list(every.keys()), "n": list(every.values()), "bad": [bad[t] for t in every]})

    counts = rows.mapInPandas(count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= MIN_DOCUMENTS)
    n, bad = F.col("n"), F.col("bad")
    part = lambda x, row, column: F.when(x > 0, x * F.ln(x * texts / (row * column))).otherwise(0.0)
    ratio = part(bad, n, toxic) + part(n - bad, n, texts - toxic) + part(toxic - bad, texts - n, toxic) + part(texts - toxic - n + bad, texts - n, texts - toxic)
    return [r.term for r in counts.orderBy(F.desc(F.round(ratio, 9)), "term").limit(most).collect()]


def learn(x: np.ndarray, y: np.ndarray, seed: int = 17) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) that lower the penalised logistic loss of rows x with labels y, by Adam."""
    share, squares = y.mean(), x * x
    values = [np.array([math.log(share / (1 - share))]), np.zeros(x.shape[1]), np.random.default_rng(seed).normal(0, SPREAD, (x.shape[1], FACTORS))]
    penalties = (0.0, WEIGHT_PENALTY, FACTOR_PENALTY)
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, ROUNDS + 1):
        bias, w, v = values
        sums = x @ v
        z = bias[0] + x @ w + 0.5 * ((sums * sums).sum(1) - (squares @ (v * v)).sum(1))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        slopes = (np.array([error.sum()]), x.T @ error, x.T @ (error[:, None] * sums) - v * (squares.T @ error)[:, None])
        for k, (slope, penalty) in enumerate(zip(slopes, penalties, strict=True)):
            slope = slope + penalty * values[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            values[k] = values[k] - STEP * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return float(values[0][0]), values[1], values[2]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    rows = scratch(training_rows(docs, labels, most), "toxicity-rows")
    texts, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    hashes = telling_terms(rows, texts, toxic) if 0 < toxic < texts else []
    if not hashes:
        drop(rows)
        share = (toxic + 0.1) / (texts + 1)
        return Machine(math.log(share / (1 - share)))
    places = {h: k for k, h in enumerate(hashes)}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(places)
        for batch in batches:
            counts = [sorted(terms(text).items()) for text in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "places": [[p for p, _ in c] for c in counts], "counts": [[n for _, n in c] for c in counts]})

    points = rows.mapInPandas(found, "label int, places array<int>, counts array<long>").toPandas()  # SAMPLE rows at most
    points = points.iloc[sorted(range(len(points)), key=lambda k: (points["label"][k], list(points["places"][k]), list(points["counts"][k])))]
    x = np.zeros((len(points), len(hashes)))
    for row, (at, n) in enumerate(zip(points["places"], points["counts"], strict=True)):
        x[row, list(at)] = np.log2(1 + np.asarray(n))
    drop(rows)
    bias, weights, factors = learn(x, points["label"].to_numpy().astype("float64"))
    return Machine(bias, hashes, weights, factors)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score, from 0 to 1."""
    places = {h: k for k, h in enumerate(machine.hashes)}

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(places)
        for batch in batches:
            found = map(terms, batch)
            yield pd.Series([machine.score(list(f), [math.log2(1 + n) for n in f.values()]) for f in found], dtype="float64")

    return docs.withColumn("score", F.round(scored(F.coalesce("text", F.lit(""))), 6))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
