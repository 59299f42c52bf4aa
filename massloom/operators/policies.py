"""Whole policies and the classifiers that report on them: status, differences, misses, gates, sweeps, production.

Conditions are column expressions; policies take and give tables. Orders end in a candidate key, and scores that aren't
finite count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import finite
from .ranking import calibrate, final_scores, fuse_guarded

#: Gates, shares, weights and thresholds that policies are reported at.
GATES = (1, 2, 3, 5)
FUSION_WEIGHTS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)
HOLDOUT_SHARE = 0.2
SUPPORT_LEVELS = (0.90, 0.95, 0.99)


def query_status(known_masses: Column, candidates: Column, truth_survived: Column) -> Column:
    """no_query_mass, zero_candidates, truth_excluded or truth_retained."""
    return F.when(known_masses == 0, "no_query_mass").when(candidates == 0, "zero_candidates").when(~truth_survived, "truth_excluded").otherwise("truth_retained")


def truth_ranks(counted: DataFrame, k: int) -> DataFrame:
    """counted with the ranks of each query's truth that the rankings would give it: present, tier, a (policy 3a), b (3c) and
    before (competition rank among candidates whose mass fits, or all where none does); null where it is no candidate.

    counted has blocks.truth_counts, in_same, in_opposite, n_same and n_opposite. Candidates are those of fitting mass, of
    either mode, and the k best; ahead of a scored truth lie the scored ones that counts tell of, and whole tiers before its own.
    """
    ahead = {x: F.col(f"above_{x}") + F.col(f"ties_{x}") for x in ("same", "opposite", "neither")}
    in_spectral = sum(ahead.values(), F.lit(0)) < k
    fallback, fits = F.col("n_same") == 0, F.col("in_same") | F.col("in_opposite")
    # those ahead of one of the k best are all among them
    a = 1 + ahead["same"] + ahead["opposite"] + F.when(in_spectral, ahead["neither"]).otherwise(F.col("top_neither"))
    tier = F.when(F.col("in_same"), 1).when(F.col("in_opposite"), 2).otherwise(3)
    b = F.when(fallback, a).when(tier == 1, 1 + ahead["same"]).when(tier == 2, 1 + F.col("n_same") + ahead["opposite"]).otherwise(1 + F.col("n_same") + F.col("n_opposite") + ahead["neither"])
    above = F.col("above_same") + F.when(fallback, F.col("above_opposite") + F.col("above_neither")).otherwise(0)
    out = counted.withColumns({"present": fits | in_spectral, "fallback": fallback, "before": F.when(fallback | F.col("in_same"), 1 + above)})
    return out.withColumns({"tier": F.when(F.col("present"), tier), "a": F.when(F.col("present"), a), "b": F.when(F.col("present"), b)})


def difference_context(present: Column, fallback: Column, cosine: Column, tier: Column, before: Column, after: Column) -> Column:
    """How a query's ranks under two policies compare: only some paths give scores that a tie can explain."""
    in_fallback = F.when(finite(cosine).isNotNull(), "fallback_comparable").otherwise("fallback_unscored_hybrid")
    hybrid = F.when(before.isNull() & after.isNotNull(), "hybrid_recovery").otherwise("hybrid_other")
    return F.when(~F.coalesce(present, F.lit(False)), "truth_absent").when(fallback, in_fallback).when(tier == 1, "tier1_nonfallback").when(tier.isin(2, 3), hybrid).otherwise("other")


def tie_explains(optimistic: Column, position: Column, ties: Column) -> Column:
    """Whether a place in a list is one of those that equal scores may take: from the optimistic rank on, ties long."""
    return position.between(optimistic, optimistic + ties - 1)


def shortlist_miss(retained: Column, formula_recovered: Column, formula_rank: Column, formula_in_asset: Column, structure_in_hypotheses: Column, depth: int = 3) -> Column:
    """The first of six reasons why a truth is not in the shortlist, or that it is."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(retained), "retained_top100")
        .when(~yes(formula_recovered), "truth_formula_not_recovered")
        .when(formula_rank.isNull() | (formula_rank > depth), "truth_formula_outside_top3")
        .when(~yes(formula_in_asset), "truth_formula_absent_pubchem_asset")
        .when(~yes(structure_in_hypotheses), "truth_structure_absent_pubchem")
        .otherwise("truth_below_top100")
    )


def usable_peaks(mzs: Column, intensities: Column, precursor: Column) -> Column:
    """How many peaks are finite, have an intensity above 0 and lie up to 1 above a finite precursor; 0 for odd arrays."""
    peaks = F.arrays_zip(mzs.alias("m"), intensities.alias("i"))
    below = lambda p: F.coalesce(p["m"] <= finite(precursor) + 1.0, F.lit(True))
    good = F.filter(peaks, lambda p: finite(p["m"]).isNotNull() & finite(p["i"]).isNotNull() & (p["i"] > 0) & below(p))
    return F.when(mzs.isNotNull() & intensities.isNotNull() & (F.size(mzs) == F.size(intensities)), F.size(good)).otherwise(0)


def support_counts(pairs: DataFrame, keys: list[str], score: str, levels=SUPPORT_LEVELS) -> DataFrame:
    """Of each key how many scores reach each level, the best one and the second best."""
    s = finite(F.col(score).cast("double"))
    ranked = pairs.withColumn("_s", s).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_s"))))
    nth = lambda n: F.max(F.when(F.col("_n") == n, F.col("_s")))
    return ranked.groupBy(*keys).agg(*[F.count_if(F.col("_s") >= t).alias(f"ge_{round(100 * t):03d}") for t in levels], nth(1).alias("best"), nth(2).alias("second"))


#: Ranges of a key's masses that least_mass_delta orders apart.
MASS_RANGES = 64


def least_mass_delta(a: DataFrame, b: DataFrame, key: str, a_mass: str, b_mass: str) -> DataFrame:
    """(key, min_delta): the least |a - b| over both tables' masses of each key, without pairing them.

    In one order of all masses the two that are nearest stand together, as any mass between them would be nearer to one. A
    key's masses fall into MASS_RANGES ranges, in order apart; then the first and last mass of each range meet the others'.
    """
    side = lambda df, m, t: df.select(key, finite(F.col(m).cast("double")).alias("_m"), F.lit(t).alias("_t")).where(f"_m is not null and `{key}` is not null").distinct()
    every = side(a, a_mass, 0).unionByName(side(b, b_mass, 1))
    spans = every.groupBy(key).agg(F.min("_m").alias("_from"), F.max("_m").alias("_to"))
    # halves, as the whole of a span may be no double
    share = F.try_divide(F.col("_m") / 2 - F.col("_from") / 2, F.col("_to") / 2 - F.col("_from") / 2)
    placed = every.join(spans, key).withColumn("_p", F.coalesce(F.floor(share * MASS_RANGES), F.lit(0)))

    def beside(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_m", "_t")
        gap = F.when(F.col("_t") != F.lag("_t").over(w), F.col("_m") - F.lag("_m").over(w))
        return rows.select(key, gap.alias("_d")).where("_d is not null")

    row = F.struct("_m", "_t")
    ends = placed.groupBy(key, "_p").agg(F.array(F.min(row), F.max(row)).alias("_e"))
    met = beside(placed, key, "_p").unionByName(beside(ends.select(key, F.inline("_e")), key))
    return met.groupBy(key).agg(F.min("_d").alias("min_delta"))


#: Ranges that dense_ids numbers apart, and the keys a range that their bounds are chosen from.
ID_RANGES, SAMPLED_A_RANGE = 64, 64


def dense_ids(df: DataFrame, key: str, name: str = "key_id") -> DataFrame:
    """df with the place of its key among the distinct keys in order, from 0; nulls have none.

    The keys fall into ID_RANGES ranges between bounds from a fixed-size sample (the least hashes). Each range is numbered
    by itself and starts after the counts of those before it, ID_RANGES numbers at most; no task holds all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    sample = keys.orderBy(F.xxhash64(key), key).limit(ID_RANGES * SAMPLED_A_RANGE)
    bounds = [r[0] for r in sample.orderBy(key).collect()][SAMPLED_A_RANGE - 1 :: SAMPLED_A_RANGE]
    part = sum((F.col(key) >= F.lit(b)).cast("int") for b in bounds) if bounds else F.lit(0)
    counts = {r[0]: r[1] for r in keys.groupBy(part.alias("_p")).agg(F.count("*")).collect()}
    starts = [sum(n for p, n in counts.items() if p < k) for k in range(len(bounds) + 1)]
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    ids = keys.withColumn("_p", part).select(key, (inside + F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("_p"))).alias(name))
    return df.join(ids, key, "left")


def restore_order(df: DataFrame, manifest: DataFrame, key: str, place: str) -> DataFrame:
    """df's rows in the manifest's order."""
    return df.join(manifest.select(key, place), key).orderBy(place)


def pooled_top_k(scores: DataFrame, query: str, spectrum: str, structure: str, k: int, pool: int | None = None, score: str = "score") -> DataFrame:
    """The k best structures of each query by their best spectrum, among its pool best spectra (max(100 k, 5000))."""
    w = Window.partitionBy(query)
    s = finite(F.col(score).cast("double"))
    near = scores.withColumn("_s", s).where("_s is not null").withColumn("_n", F.row_number().over(w.orderBy(F.desc("_s"), F.asc(spectrum)))).where(F.col("_n") <= (pool or max(100 * k, 5000)))
    best = near.groupBy(query, structure).agg(F.max("_s").alias(score))
    return best.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), F.asc(structure)))).where(F.col("rank") <= k)


def expand_formulas(hypotheses: DataFrame, structures: DataFrame, formula: str) -> DataFrame:
    """Every structure of every hypothesis' formula: many to many, both sides keep their columns."""
    return hypotheses.join(structures, formula)


def per_spectrum_scores(scores: DataFrame, fits: DataFrame, spectrum: str, candidate: str, query: str) -> DataFrame:
    """(query, candidate, score, fallback): each spectrum's scores of the candidates that fit its mass, or all of its
    scores where none fits; then the greatest over a query's spectra. fallback: no spectrum of the query had a fit."""
    matched = scores.join(fits.select(spectrum, candidate).distinct(), [spectrum, candidate], "left_semi").withColumn("_f", F.lit(False))
    rest = scores.join(fits.select(spectrum).distinct(), spectrum, "left_anti").withColumn("_f", F.lit(True))
    merged = matched.unionByName(rest).withColumn("_s", finite(F.col("score").cast("double"))).groupBy(query, candidate).agg(F.max("_s").alias("score"), F.every("_f").alias("_f"))
    return merged.withColumn("fallback", F.every("_f").over(Window.partitionBy(query))).drop("_f")


def two_source_scores(filtered: DataFrame, fallback: DataFrame, spectrum: str, candidate: str, query: str) -> DataFrame:
    """(query, candidate, score, n_filtered, n_fallback): each spectrum by its filtered rows, or, where it has none, by its
    rows of another table; then the greatest of a query's spectra.

    filtered and fallback come from different searches, as cross-polarity mass candidates beside all of the own polarity,
    so no row of the one stands in for the other. A filtered row without a finite score still counts as one.
    """
    value = finite(F.col("score").cast("double"))
    own = filtered.select(query, candidate, spectrum, value.alias("_s"), F.lit(1).alias("_n"), F.lit(0).alias("_f"))
    rest = fallback.join(filtered.select(spectrum).distinct(), spectrum, "left_anti").select(query, candidate, spectrum, value.alias("_s"), F.lit(0).alias("_n"), F.lit(1).alias("_f"))
    return own.unionByName(rest).groupBy(query, candidate).agg(F.max("_s").alias("score"), F.sum("_n").alias("n_filtered"), F.sum("_f").alias("n_fallback"))


def intrusions(ranked: DataFrame, query: str, candidate: str, rank: str, formula: str, truth: str, truth_formula: str) -> DataFrame:
    """A row a query whose truth is ranked: its place, how many rows of its own and of other formulas stand above it, the
    other formulas among them, and the place it would have among its own formula alone.

    ranked carries the query's truth and truth_formula on every row. The truth's place is a window maximum and what is
    above it a conditional count, so the ranking isn't joined with itself.
    """
    w = Window.partitionBy(query)
    placed = ranked.withColumn("_t", F.max(F.when(F.col(candidate) == F.col(truth), F.col(rank))).over(w)).where("_t is not null")
    above, own = F.col(rank) < F.col("_t"), F.coalesce(F.col(formula) == F.col(truth_formula), F.lit(False))
    return placed.groupBy(query).agg(
        F.max("_t").alias("truth_rank"), F.count_if(above & own).alias("own_above"), F.count_if(above & ~own).alias("intruders"),
        F.count_distinct(F.when(above & ~own, F.col(formula))).alias("intruding_formulas"), (F.count_if(above & own) + 1).alias("oracle_formula_rank"),
    )


def fallback_ranking(merged: DataFrame, smiles: DataFrame, query: str, candidate: str, text: str, k: int = 25) -> DataFrame:
    """merged scores with their structures' texts; blank ones dropped, the k best of each query numbered anew."""
    named = merged.join(smiles.select(candidate, F.trim(text).alias(text)), candidate).where(F.col(text) != "").where("score is not null")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(candidate)))).where(F.col("rank") <= k)


_STRATEGIES = {
    "support_count": lambda: [F.desc("support_count"), F.asc("min_abs_ppm")],
    "support_fraction": lambda: [F.desc("support_fraction"), F.asc("min_abs_ppm")],
    "mass_error": lambda: [F.asc("min_abs_ppm"), F.desc("support_count")],
}


def formula_strategies(hypotheses: DataFrame, molecule: str, formula: str) -> DataFrame:
    """hypotheses once for each strategy, with strategy and its rank of the formula.

    One pass: the three orders are windows of one partitioning, and their ranks are unfolded afterwards.
    """
    ranks = {f"_{name}": F.row_number().over(Window.partitionBy(molecule).orderBy(*order(), F.asc(formula))) for name, order in _STRATEGIES.items()}
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(f"_{name}").alias("strategy_rank")) for name in _STRATEGIES]))
    return hypotheses.withColumns(ranks).select(*hypotheses.columns, each)


def formula_gates(ranked: DataFrame, burden: DataFrame, molecule: str, formula: str, truth: Column, gates=GATES) -> DataFrame:
    """By strategy and gate: molecules, those whose truth is among the first formulas, and the candidates to look at."""
    counted = ranked.join(burden, formula, "left").withColumns({"_b": F.coalesce("candidate_count", F.lit(0)), "_t": F.coalesce(truth, F.lit(False))})
    each = counted.withColumn("gate", F.explode(F.array(*map(F.lit, gates))))
    inside = F.col("strategy_rank") <= F.col("gate")
    by_molecule = each.groupBy("strategy", "gate", molecule).agg(F.bool_or(inside & F.col("_t")).alias("_h"), F.sum(F.when(inside, F.col("_b")).otherwise(0)).alias("_b"))
    return by_molecule.groupBy("strategy", "gate").agg(F.count("*").alias("molecules"), F.count_if("_h").alias("recovered"), F.sum("_b").alias("candidates"))


def better_rank(a: Column, b: Column) -> Column:
    """The lesser of two ranks, either of which may be missing: an oracle of two rankings."""
    return F.least(a, b)


def threshold_sweep(ranks: DataFrame, few: str, many: str, count: str, thresholds) -> DataFrame:
    """MRR@25, top-25 and misses of taking few's rank for up to so many candidates and many's beyond, by threshold."""
    each = ranks.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    rank = F.when(F.col(count) <= F.col("threshold"), F.col(few)).otherwise(F.col(many))
    return each.withColumn("_r", rank).groupBy("threshold").agg(F.avg(F.when(F.col("_r") <= 25, 1.0 / F.col("_r")).otherwise(0.0)).alias("mrr"), F.avg(F.when(F.col("_r") <= 25, 1.0).otherwise(0.0)).alias("top25"), F.count_if(F.col("_r").isNull()).alias("missing"))


def conditional_hybrid(fused: DataFrame, query: str, candidate: str, rank: str, score: str, most: int = 100) -> DataFrame:
    """Queries of at most so many candidates go by rank, others by fused score; hybrid_rank."""
    few = F.count("*").over(Window.partitionBy(query)) <= most
    value = F.when(few, -F.col(rank).cast("double")).otherwise(finite(F.col(score)))
    return fused.withColumn("_v", value).withColumn("hybrid_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("_v"), F.asc(candidate)))).drop("_v")


def rank_sum_sweep(fused: DataFrame, query: str, candidate: str, a_rank: str, b_rank: str, weights=FUSION_WEIGHTS) -> DataFrame:
    """fused once for each weight, ranked by a_rank + weight * b_rank, then a_rank, b_rank and candidate."""
    each = fused.withColumn("weight", F.explode(F.array(*map(F.lit, weights)))).withColumn("_v", F.col(a_rank) + F.col("weight") * F.col(b_rank))
    order = [F.asc_nulls_last(c) for c in ("_v", a_rank, b_rank)]
    return each.withColumn("sweep_rank", F.row_number().over(Window.partitionBy(query, "weight").orderBy(*order, F.asc(candidate)))).drop("_v")


def mass_penalised(cosine: Column, ppm: Column, penalty: float) -> Column:
    """cosine - penalty * |ppm|."""
    return finite(cosine) - penalty * F.abs(ppm)


def ranker_features(candidates: DataFrame, query: str, formula: str, prior_rank: str, formula_rank: str) -> DataFrame:
    """candidates with counts by query and formula, their log1p, and reciprocal ranks."""
    q, f = Window.partitionBy(query), Window.partitionBy(query, formula)
    out = candidates.withColumns({"query_candidate_count": F.count("*").over(q), "formula_candidate_count": F.count("*").over(f)})
    return out.withColumns({
        "log_query_candidate_count": F.log1p("query_candidate_count"), "log_formula_candidate_count": F.log1p("formula_candidate_count"),
        "inverse_prior_rank": F.try_divide(F.lit(1.0), F.col(prior_rank)), "inverse_formula_rank": F.try_divide(F.lit(1.0), F.col(formula_rank)),
    })


def query_split(keys: DataFrame, key: str, share: float = HOLDOUT_SHARE, seed: int = 42) -> DataFrame:
    """(key, split): train, or holdout where the key's hash falls in the share; no key is in both."""
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("split", F.when(place < int(share * (1 << 32)), "holdout").otherwise("train"))


def guarded_production(prior: DataFrame, other: DataFrame, distances: DataFrame, hypotheses: DataFrame, molecule: str, spec: str, candidate: str, distance: str, ppm: str, depth: int = 5) -> DataFrame:
    """The production ranking: in each hypothesis (spec) the guard keeps the first depth of the prior's order and fuses the
    rest, places get the distance at the same place of the spec's sorted distances, the formula's mass error is taken
    off, and the best of each candidate over a molecule's hypotheses is ranked. hypotheses: (spec, molecule, ppm)."""
    guarded = fuse_guarded(prior, other, spec, candidate, "prior_rank", "other_rank", depth)
    placed = calibrate(guarded, distances, spec, "guarded_rank", distance)
    named = placed.join(hypotheses.select(spec, molecule, ppm), spec).withColumn("hypothesis_spec", F.col(spec))
    return final_scores(named, molecule, candidate, ppm)

