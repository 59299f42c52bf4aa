"""Ranking policies: hybrid candidates, tiers, fusions, collapses, calibration, neighbour priors, submissions.

Scores that don't exist, are NaN or infinite are nulls and sort last; every order ends in a candidate key, so it is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import finite
from .relational import average_percentile, dedupe_first

RRF_K = 60
MASS_PENALTY = 0.02


def _rank(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top_candidates(scores: DataFrame, query: str, candidate: str, k: int, score: str = "score") -> DataFrame:
    """The k best finite scores of each query with spectral_rank."""
    ok = scores.where(finite(F.col(score)).isNotNull())
    return ok.withColumn("spectral_rank", _rank([query], F.desc(score), F.asc(candidate))).where(F.col("spectral_rank") <= k)


def hybrid_candidates(same: DataFrame, opposite: DataFrame, spectral: DataFrame, query: str, candidate: str) -> DataFrame:
    """The union of three candidate sets with flags in_same_mass, in_opposite_mass, in_spectral and spectral_rank."""
    marks = [same.select(query, candidate, F.lit(0).alias("_s"), F.lit(None).cast("int").alias("_r")), opposite.select(query, candidate, F.lit(1).alias("_s"), F.lit(None).cast("int").alias("_r")), spectral.select(query, candidate, F.lit(2).alias("_s"), F.col("spectral_rank").alias("_r"))]
    every = marks[0].unionByName(marks[1]).unionByName(marks[2])
    flag = lambda i, name: F.bool_or(F.col("_s") == i).alias(name)
    return every.groupBy(query, candidate).agg(flag(0, "in_same_mass"), flag(1, "in_opposite_mass"), flag(2, "in_spectral"), F.min("_r").alias("spectral_rank"))


def candidate_features(hybrid: DataFrame, full: DataFrame, restricted: DataFrame, query: str, candidate: str) -> DataFrame:
    """hybrid with same_polarity_cosine from full and same_mass_cosine from restricted scores; null where unscored."""
    f = full.select(query, candidate, F.col("score").alias("same_polarity_cosine"))
    r = restricted.select(query, candidate, F.col("score").alias("same_mass_cosine"))
    return hybrid.join(f, [query, candidate], "left").join(r, [query, candidate], "left")


def rank_by_cosine(features: DataFrame, query: str, candidate: str) -> DataFrame:
    """Policy 3a: all sources together by full cosine."""
    return features.withColumn("rank", _rank([query], finite(F.col("same_polarity_cosine")).desc_nulls_last(), F.asc(candidate)))


def rank_by_tier(features: DataFrame, query: str, candidate: str, own_scores: bool = True) -> DataFrame:
    """Policies 3b and 3c: by source tier, then score, then candidate; where fallback holds, by score alone.

    own_scores (3c): tier 1 goes by same_mass_cosine. Candidates without a score stay, last of their tier.
    """
    tier = F.when(F.col("in_same_mass"), 1).when(F.col("in_opposite_mass"), 2).otherwise(3)
    score = F.when((tier == 1) & F.lit(own_scores), F.col("same_mass_cosine")).otherwise(F.col("same_polarity_cosine"))
    fallback = F.coalesce(F.col("fallback"), F.lit(False)) if "fallback" in features.columns else F.lit(False)
    key = F.when(fallback, 0).otherwise(tier)
    value = F.when(fallback, F.col("same_polarity_cosine")).otherwise(score)
    return features.withColumn("tier", tier).withColumn("rank", _rank([query], F.asc_nulls_last(key), finite(value).desc_nulls_last(), F.asc(candidate)))


def promote_spectral_first(ranked: DataFrame, query: str, candidate: str) -> DataFrame:
    """A counterfactual: the best spectral match, if it is in tier 3, comes first."""
    first = (F.col("tier") == 3) & (F.coalesce(F.col("spectral_rank"), F.lit(0)) == 1)
    return ranked.withColumn("rank", _rank([query], F.desc(first), F.asc("rank"), F.asc(candidate)))


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Sum of 1 / (k + rank) over the ranks that exist."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return out


def fuse_rrf(a: DataFrame, b: DataFrame, query: str, candidate: str, a_rank: str, b_rank: str, k: int = RRF_K) -> DataFrame:
    """Full outer of two rankings by reciprocal rank fusion."""
    both = a.select(query, candidate, a_rank).join(b.select(query, candidate, b_rank), [query, candidate], "full_outer")
    both = both.withColumn("rrf_score", rrf(F.col(a_rank), F.col(b_rank), k=k))
    return both.withColumn("fused_rank", _rank([query], F.desc("rrf_score"), F.asc(candidate)))


def fuse_guarded(a: DataFrame, b: DataFrame, query: str, candidate: str, prior_rank: str, other_rank: str, depth: int = 5, k: int = RRF_K) -> DataFrame:
    """The first depth of the prior ranking keep their places; the rest follows by reciprocal rank fusion."""
    both = a.select(query, candidate, prior_rank).join(b.select(query, candidate, other_rank), [query, candidate], "full_outer")
    kept = F.coalesce(F.col(prior_rank) <= depth, F.lit(False))
    score = rrf(F.col(prior_rank), F.col(other_rank), k=k)
    both = both.withColumn("protected", kept).withColumn("rrf_score", score)
    rank = _rank([query], F.desc("protected"), F.when(F.col("protected"), F.col(prior_rank)).asc_nulls_last(), F.when(~F.col("protected"), F.col("rrf_score")).desc_nulls_last(), F.asc(candidate))
    return both.withColumn("guarded_rank", rank)


def adaptive(fused: DataFrame, query: str, few: str, many: str, most: int = 100) -> DataFrame:
    """few's rank for queries of at most so many candidates, else many's."""
    n = F.count("*").over(Window.partitionBy(query))
    return fused.withColumn("adaptive_rank", F.when(n <= most, F.col(few)).otherwise(F.col(many)))


def collapse(candidates: DataFrame, query: str, candidate: str, policy: str, penalty: float = 0.0) -> DataFrame:
    """One row a candidate over formulas: policy formula_first, round_robin or rank_penalty orders what is kept and ranked."""
    score = F.col("prior_rank").cast("double") + penalty * (F.col("formula_rank") - 1.0)
    orders = {"formula_first": ["formula_rank", "prior_rank"], "round_robin": ["prior_rank", "formula_rank"], "rank_penalty": ["_score", "formula_rank", "prior_rank"]}
    if policy not in orders:
        raise ValueError(f"unknown policy {policy!r}")
    by = [F.asc_nulls_last(c) for c in orders[policy]]
    kept = dedupe_first(candidates.withColumn("_score", score), [query, candidate], by)
    return kept.withColumn("collapse_rank", _rank([query], *by, F.asc(candidate))).drop("_score")


def calibrate(ranked: DataFrame, distances: DataFrame, spec: str, rank: str, distance: str) -> DataFrame:
    """ranked with calibrated_distance: the distance at the same place of the spec's sorted distances, the last beyond.

    A hypothesis without any finite distance is an error, not a hypothesis less.
    """
    n = Window.partitionBy(spec)
    places = distances.where(finite(F.col(distance)).isNotNull()).select(spec, F.col(distance).alias("calibrated_distance"), F.row_number().over(n.orderBy(distance)).alias("_place"), F.count("*").over(n).alias("_n"))
    sizes = places.where("_place = 1").select(spec, "_n")
    known = F.coalesce(F.col("_n"), F.raise_error(F.concat(F.lit("no distance for "), F.col(spec).cast("string"))).cast("long"))
    named = ranked.join(sizes, spec, "left").withColumn("_place", F.least(F.col(rank), known).cast("int")).drop("_n")
    return named.join(places.drop("_n"), [spec, "_place"]).drop("_place")


def final_scores(ranked: DataFrame, molecule: str, candidate: str, ppm: str, penalty: float = MASS_PENALTY) -> DataFrame:
    """-distance - penalty * |ppm|, the best of each candidate over hypotheses, ranked by molecule."""
    scored = ranked.withColumn("final_score", finite(-F.col("calibrated_distance") - penalty * F.abs(ppm)))
    best = dedupe_first(scored, [molecule, candidate], [F.desc_nulls_last("final_score"), *[F.asc_nulls_last(c) for c in ("hypothesis_spec",) if c in ranked.columns]])
    return best.withColumn("rank", _rank([molecule], F.desc_nulls_last("final_score"), F.asc(candidate)))


def percentile_blend(df: DataFrame, keys: list[str], a: str, b: str, weight: float) -> DataFrame:
    """weight * percentile of a + (1 - weight) * percentile of b, ties averaged."""
    both = average_percentile(average_percentile(df, keys, a, "_pa"), keys, b, "_pb")
    return both.withColumn("blend", weight * F.col("_pa") + (1 - weight) * F.col("_pb")).drop("_pa", "_pb")


def neighbor_prior(candidates: DataFrame, neighbors: DataFrame, query: str, candidate: str, similarity: Column) -> DataFrame:
    """prior = greatest similarity * max(spectral score, 0) over a query's neighbours, with usable_neighbors and prior_rank.

    The two tables join on the query; similarity is an expression over both.
    """
    pairs = candidates.join(neighbors, query).withColumn("_s", finite(similarity * F.greatest(finite(F.col("spectral_score")), F.lit(0.0))))
    out = pairs.groupBy(query, candidate).agg(F.max("_s").alias("prior"), F.countDistinct("neighbor").alias("usable_neighbors"))
    return out.withColumn("prior_rank", _rank([query], F.desc_nulls_last("prior"), F.asc(candidate)))


def neighbor_features(pairs: DataFrame, query: str, candidate: str, similarity: str = "similarity", weight: str = "spectral_score") -> DataFrame:
    """Summaries of a candidate's similarities to its query's neighbours."""
    w = Window.partitionBy(query, candidate)
    ranked = pairs.withColumn("_n", F.row_number().over(w.orderBy(finite(F.col(similarity)).desc_nulls_last(), F.asc("neighbor"))))
    s, g = finite(F.col(similarity)), F.col(weight)
    top = lambda k: F.avg(F.when(F.col("_n") <= k, s))
    over = lambda t: F.count_if(s >= t).alias(f"count_ge_{str(t).replace('.', '')}")
    return ranked.groupBy(query, candidate).agg(
        F.max(s).alias("max_similarity"), F.avg(s).alias("mean_similarity"), top(3).alias("top3_mean"), top(5).alias("top5_mean"),
        F.try_divide(F.sum(s * g), F.sum(g)).alias("weighted_mean"), over(0.3), over(0.5), over(0.7),
        F.max(F.when(F.col("_n") == 1, F.col("neighbor"))).alias("best_neighbor"), F.max(F.when(F.col("_n") == 1, g)).alias("best_neighbor_score"),
    )


def formula_hypotheses(matches: DataFrame, molecule: str, spectrum: str, formula: str, ppm: str, usable: DataFrame) -> DataFrame:
    """Support of each (molecule, formula) by its spectra, the best spectrum, and the order of hypotheses.

    usable: (molecule, spectrum) of all spectra that could have matched; the fraction's denominator.
    """
    total = usable.groupBy(molecule).agg(F.countDistinct(spectrum).alias("usable_spectra"))
    best = dedupe_first(matches, [molecule, formula], [F.abs(ppm), F.asc(spectrum)]).select(molecule, formula, F.col(spectrum).alias("best_spectrum"), F.col(ppm).alias("best_ppm"))
    support = matches.groupBy(molecule, formula).agg(F.countDistinct(spectrum).alias("support_count"), F.min(F.abs(ppm)).alias("min_abs_ppm"))
    out = support.join(total, molecule).join(best, [molecule, formula]).withColumn("support_fraction", F.col("support_count") / F.col("usable_spectra"))
    return out.withColumn("formula_rank", _rank([molecule], F.desc("support_count"), F.asc("min_abs_ppm"), F.asc(formula)))


def submission(branches: list[DataFrame], molecule: str, smiles: str, expected: DataFrame | None = None, k: int = 25) -> DataFrame:
    """(molecule, smiles): at most k distinct texts in order of rank, joined by semicolons.

    Branches must not share a molecule, and together cover expected if it is given; blank texts are dropped.
    """
    seen = branches[0].select(molecule).distinct()
    for b in branches[1:]:
        more = b.select(molecule).distinct()
        if not seen.intersect(more).isEmpty():
            raise ValueError("branches share molecules")
        seen = seen.unionByName(more)
    if expected is not None and not expected.select(molecule).distinct().join(seen, molecule, "left_anti").isEmpty():
        raise ValueError("molecules without a ranking")
    rows = branches[0].select(molecule, smiles, "rank")
    for b in branches[1:]:
        rows = rows.unionByName(b.select(molecule, smiles, "rank"))
    rows = rows.withColumn(smiles, F.trim(smiles)).where(F.col(smiles) != "")
    once = rows.groupBy(molecule, smiles).agg(F.min("rank").alias("_r"))
    numbered = once.withColumn("_n", _rank([molecule], F.asc("_r"), F.asc(smiles))).where(F.col("_n") <= k)
    return numbered.groupBy(molecule).agg(F.expr(f"listagg(`{smiles}`, ';') WITHIN GROUP (ORDER BY _n)").alias(smiles))
