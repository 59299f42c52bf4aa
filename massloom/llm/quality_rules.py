"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Every rule looks at one measured ratio of a document and votes good (1), bad (-1) or abstains (0). The latent class of
a document is never seen: it is good, or bad in one of several ways, since noise, shouting and repetition share few votes.
There is one bad kind a rule. Expectation-maximisation over the counts of vote patterns estimates the share of each class
and, for each class and rule, the chance of a bad vote where the rule votes (a Dawid-Skene model with abstention, where
an abstention says nothing of the class). No chance is capped. What the author of a rule expects of it, the share of good
documents that it wrongly calls bad, is a prior with the weight of TRUST documents for each document seen, so it counts
alike at every size; votes that the other rules contradict move it. A rule's lone bad votes thus reject a document
where they are more frequent than the rule's errors can explain, and are outvoted where they are not.
What EM reads is the table of patterns, at most 3 ** len(RULES) rows whatever the corpus, counted over all documents. The
posterior chance that a document is good takes the place of passing every rule. Only DataFrame functions touch documents.

Edge cases: a null, empty or blank text has no words, all measures 0, abstains on every ratio and fails the base rules.
Repeated rows are judged alike, each on its own row. Very long texts are measured whole, as arrays of their words. A
posterior of exactly the threshold is kept. An empty table gives an empty result. Other columns pass through; working
columns are prefixed with q__ to clash with none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, scratch, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def repeat_words(ws: Column) -> Column:
    """Words inside WINDOW-word windows that the text holds twice or more, the first included.

    Windows compare by a 64-bit hash, built by doubling: 2, 4, then 8 words. Positions of repeated windows, sorted,
    cover min(8, step to the next) words each, so the count needs one sort and no search.
    """

    def pairs(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def counted(h: Column) -> Column:
        def repeated(ps: Column) -> Column:
            near = lambda e, i: (F.get(ps, i - 1)["h"] == e["h"]) | (F.get(ps, i + 1)["h"] == e["h"])
            found = F.filter(ps, lambda e, i: F.coalesce(near(e, i), F.lit(False)) | F.coalesce(F.get(ps, i + 1)["h"] == e["h"], F.lit(False)))
            return let(
                F.sort_array(F.transform(found, lambda e: e["i"])),
                lambda pos: F.aggregate(
                    F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda s, x: s + x,
                ),
            )

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, repeated))

    n = F.size(ws)
    doubled = let(
        F.transform(ws, lambda x: F.xxhash64(x)),
        lambda h: let(pairs(h, 1), lambda h2: let(pairs(h2, 2), lambda h4: pairs(h4, 4))),
    )
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(F.slice(doubled, 1, F.greatest(n - WINDOW + 1, F.lit(1))), counted))


def measures(text: Column) -> Column:
    """A struct of what the rules look at."""
    body = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.char_length(body) - F.char_length(F.regexp_replace(body, pattern, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(
        words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike("[\\p{Alnum}\\p{IsAlphabetic}][.!?:;,\"')\\]]{0,2}[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_closed_lines"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            s["w"]["word_chars"].alias("word_chars"),
            left("[#*$%&|<>]").cast("long").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n_lines"].alias("n_lines"),
            s["l"]["n_closed_lines"].alias("n_closed_lines"),
            left("\\p{Lu}").cast("long").alias("n_upper"),
            F.regexp_count(body, F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        ),
    )


def _vote(ratio: Column, good, bad) -> Column:
    return F.when(bad(ratio), -1).when(good(ratio), 1).otherwise(0)


#: name: vote, from the struct of measures. Null ratios (nothing to divide by) abstain.
RULES = {
    "symbols": lambda m: _vote(F.try_divide(m["n_symbols"], m["n_words"]), lambda r: r <= 0.02, lambda r: r >= 0.2),
    "capitals": lambda m: _vote(F.try_divide(m["n_upper"], m["word_chars"]), lambda r: r <= 0.15, lambda r: r >= 0.5),
    "shouting": lambda m: _vote(F.try_divide(m["n_shouts"], m["n_words"]), lambda r: r <= 0.01, lambda r: r >= 0.1),
    "repeats": lambda m: _vote(F.try_divide(m["n_repeat_words"], m["n_words"]), lambda r: r <= 0.05, lambda r: r >= 0.3),
    "same_lines": lambda m: _vote(F.try_divide(m["n_dup_lines"], m["n_lines"]), lambda r: r <= 0.2, lambda r: r >= 0.5),
    "word_length": lambda m: _vote(F.try_divide(m["word_chars"], m["n_words"]), lambda r: r.between(2.5, 9.0), lambda r: (r < 1.8) | (r > 14.0)),
    "closed_lines": lambda m: _vote(F.try_divide(m["n_closed_lines"], m["n_lines"]), lambda r: r >= 0.6, lambda r: r <= 0.1),
    "length": lambda m: F.when(m["n_words"] >= 50, 1).when(m["n_words"] < MIN_WORDS, -1).otherwise(0),
}


#: The share of good documents that each rule is expected to call bad.
EXPECTED_WRONG = {"symbols": 0.003, "capitals": 0.02, "shouting": 0.005, "repeats": 0.003, "same_lines": 0.01, "word_length": 0.05, "closed_lines": 0.05, "length": 0.05}
#: Weights of the priors: of EXPECTED_WRONG and of the classes' shares, in documents for each document seen; of what a bad
#: kind is like for other rules, in documents for each document of the kind, so that no kind comes to mimic good documents.
TRUST, KIND = 0.1, 0.02
#: Prior chances of a bad vote on a document of a bad kind: by the kind's own rule, and by any other.
OWN_BAD, OTHER_BAD = 0.9, 0.2
#: Prior share of good documents; the kinds divide the rest.
GOOD = 0.8


@dataclass(frozen=True)
class VoteModel:
    """share[c]: of class c, 0 the good one and k + 1 the bad kind of rule k; bad[c][rule]: chance of a bad vote."""

    share: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    @property
    def prior(self) -> float:
        return self.share[0]

    def accuracy(self, rule: int) -> float:
        """Chance that the rule is right where it votes."""
        return self.share[0] * (1 - self.bad[0][rule]) + sum(s * b[rule] for s, b in zip(self.share[1:], self.bad[1:]))


def _expected(n_rules: int, wrong: tuple[float, ...]) -> list[list[float]]:
    return [list(wrong), *[[OWN_BAD if j == k else OTHER_BAD for j in range(n_rules)] for k in range(n_rules)]]


def fit(counts: dict[tuple[int, ...], int], wrong: tuple[float, ...] | None = None, rounds: int = 500) -> VoteModel:
    """EM over counts of vote patterns, from the priors on; wrong: the errors expected of each rule on good documents."""
    n_rules = len(next(iter(counts), tuple(RULES)))
    wrong = wrong or tuple(EXPECTED_WRONG.values())
    total = max(1, sum(counts.values()))
    means = _expected(n_rules, wrong)
    shares = [GOOD, *[(1 - GOOD) / n_rules] * n_rules]
    model = VoteModel(tuple(shares), tuple(map(tuple, means)))
    for _ in range(rounds):
        mass = [0.0] * (n_rules + 1)
        seen = [[[0.0, 0.0] for _ in range(n_rules)] for _ in range(n_rules + 1)]
        for p, n in counts.items():
            for c, chance in enumerate(class_chances(model, p)):
                mass[c] += chance * n
                for j, v in enumerate(p):
                    if v:
                        seen[c][j][v > 0] += chance * n
        weights = [TRUST * total, *[KIND * m + 1e-6 for m in mass[1:]]]
        bad = tuple(tuple((x[0] + w * m) / (x[0] + x[1] + w) for x, m in zip(row, mean)) for row, w, mean in zip(seen, weights, means))
        all_mass = [m + TRUST * total * s for m, s in zip(mass, shares)]
        before, model = model, VoteModel(tuple(m / sum(all_mass) for m in all_mass), bad)
        if max(abs(x - y) for x, y in zip(before.share, model.share)) < 1e-10:
            break
    return model


def _scores(model: VoteModel, pattern: tuple[int, ...]) -> list[float]:
    return [math.log(s) + sum(math.log(b if v < 0 else 1 - b) for b, v in zip(row, pattern) if v) for s, row in zip(model.share, model.bad)]


def class_chances(model: VoteModel, pattern: tuple[int, ...]) -> list[float]:
    """Posterior chances of the classes given a pattern of votes; the first is that of a good document."""
    scores = _scores(model, pattern)
    top = max(scores)
    e = [math.exp(x - top) for x in scores]
    return [x / sum(e) for x in e]


def votes(m: Column) -> Column:
    return F.struct(*[rule(m).cast("int").alias(name) for name, rule in RULES.items()])


def pattern_counts(frame: DataFrame, column: str) -> dict[tuple[int, ...], int]:
    """Counts of vote patterns over all rows; at most 3 ** len(RULES) of them reach the driver."""
    rows = frame.groupBy(*[F.col(f"{column}.{k}").alias(k) for k in RULES]).count().collect()
    return {tuple(r[k] for k in RULES): r["count"] for r in rows}


def posterior(model: VoteModel, v: Column) -> Column:
    """Chance of a good document, as an expression of its votes."""

    def score(c: int) -> Column:
        out = F.lit(math.log(model.share[c]))
        for name, b in zip(RULES, model.bad[c]):
            out = out + F.when(v[name] < 0, math.log(b)).when(v[name] > 0, math.log(1 - b)).otherwise(0.0)
        return out

    return let(F.array(*[score(c) for c in range(len(model.share))]), lambda s: 1 / F.aggregate(s, F.lit(0.0), lambda t, x: t + F.exp(x - F.get(s, 0))))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: id, the measures, base_failed, the votes, p_good, kept.

    One pass measures texts and votes; the narrow result is a scratch table, from which patterns are counted and to
    which the posterior is added.
    """
    seen = docs.select(F.col(id_column), measures(F.col(text_column)).alias("q__m"))
    seen = scratch(seen.select(id_column, "q__m", votes(F.col("q__m")).alias("q__v")), "quality")
    model = fit(pattern_counts(seen, "q__v"))
    m, failed = F.col("q__m"), base_failed(F.col("q__m"))
    out = seen.withColumn("q__p", posterior(model, F.col("q__v")))
    return out.select(id_column, *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), F.col("q__v").alias("votes"), F.col("q__p").alias("p_good"), (~failed & (F.col("q__p") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() would keep, all columns as they are.

    Texts are measured once: documents are written with their votes, the patterns counted, and the table read again.
    """
    seen = docs.withColumn("q__m", measures(F.col(text_column)))
    seen = scratch(seen.select(*docs.columns, votes(F.col("q__m")).alias("q__v"), base_failed(F.col("q__m")).alias("q__failed")), "qualitydocs")
    model = fit(pattern_counts(seen, "q__v"))
    return seen.where(~F.col("q__failed") & (posterior(model, F.col("q__v")) >= threshold)).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
