"""Ranking metrics and classifiers as column expressions. A missing rank counts as 0, never as an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for null, NaN and infinities."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def reciprocal_rank(truth: Column, predicted: Column, k: int = 25) -> Column:
    """1 / position of truth in the first k of an array, else 0."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.array_position(F.slice(predicted, 1, k), truth)), F.lit(0.0))


def reciprocal_of_rank(rank: Column, k: int = 25) -> Column:
    return F.when(rank <= k, 1.0 / rank).otherwise(0.0)


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def metric_columns(rank: Column, k: int = 25, tops=(1, 5, 10, 25)) -> list[Column]:
    """Aggregates of a rank column: mrr and top-n hit rates over all rows."""
    return [F.avg(reciprocal_of_rank(rank, k)).alias("mrr"), *[F.avg(hit(rank, t)).alias(f"top{t}") for t in tops]]


def mean_reciprocal_rank(ranks: DataFrame, rank: str = "rank", k: int = 25) -> DataFrame:
    """One row with mrr; an error if there is no row."""
    return ranks.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no rankings")).cast("double")).otherwise(F.avg(reciprocal_of_rank(F.col(rank), k))).alias("mrr"))


def random_expectation(n: Column, k: int = 25) -> Column:
    """The expected reciprocal rank of a random order of n candidates."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k))), F.lit(0.0), lambda s, x: s + 1.0 / x) / n


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "not_rankable").when(rank == 1, "rank_1").when(rank <= 5, "rank_2_5").when(rank <= 25, "rank_6_25").otherwise("rank_gt_25")


def cut(value: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Right-closed bins (edge, next edge]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        above = (value >= low) if include_lowest and low == edges[0] else (value > low)
        out = F.when(above & (value <= high), label).otherwise(out)
    return out


def source_tier(same: Column, opposite: Column) -> Column:
    """1 for a candidate of the same mass and mode, 2 of the opposite mode, 3 by its spectrum alone."""
    return F.when(same, 1).when(opposite, 2).otherwise(3)


def shortlist_size(n: Column) -> Column:
    """All of up to 500 candidates, 250 of up to 1000, else 100."""
    return F.when(n <= 500, n).when(n <= 1000, 250).otherwise(100)


def miss_reason(in_candidates: Column, rank: Column, k: int = 25) -> Column:
    return F.when(~in_candidates, "candidate_miss").when(rank.isNull(), "unscored").when(rank > k, "ranking_miss").otherwise("hit")
