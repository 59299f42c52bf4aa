"""Pairs of sets that may reach a Jaccard similarity, by an exact prefix filter, with classes in place of all pairs.

Each set's shingles stand in one order, those in fewest sets first. If two sets of n and m shingles reach the similarity
num / den, they have num / (num + den) of n + m in common; from the first common one on, both have at least so many left.
So that one lies in the front of both, and what many sets share, at the end of the order, is hardly looked at.

Where many sets share a front shingle they are mostly one family. Its members meet a leader first (led()), links make
classes, and only members of different classes are then paired (crossed()), one of them outside the largest class. Both
demand that what is left of both allows a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch


def front(each: DataFrame, keys: list[str], num: int, den: int, name: str) -> DataFrame:
    """(s, rep, n, rem) of each (rep, n, s, other keys): front shingles s of sets of n shingles, with rem left from s on.

    Shingles that no other set has are not among them, nor counted in rem. keys tell sets apart.
    """
    often = each.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    from_here = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("often"), F.desc("s")))
    out = each.join(often, "s").select("s", "rep", "n", from_here.alias("rem")).where(f"{den} * rem >= {num} * n")
    return scratch(out, name)


def _room(num: int, den: int) -> str:
    return f"{num + den} * least(xr, yr) >= {num} * (xn + yn)"


def _classed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members (rep, ...) with their class in found (node, component); None: each is its own."""
    if found is None:
        return members.withColumn("component", F.col("rep"))
    return members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _side(df: DataFrame, k: str) -> DataFrame:
    return df.select("s", F.col("rep").alias(k), F.col("n").alias(f"{k}n"), F.col("rem").alias(f"{k}r"), F.col("component").alias(f"{k}c"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def led(fronts: DataFrame, found: DataFrame | None, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of each shingle's sets with a leader of another class: the least changed set first, then any."""
    members = _classed(fronts, found)
    first = F.col("rem") / F.col("n") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    lead = members.groupBy("s").agg(F.max(F.struct(first.alias("o"), F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("rem").alias("yr"), F.col("component").alias("yc"))).alias("l"))
    return _pairs(_side(members, "x").join(lead.select("s", "l.*"), "s").where(f"xc <> yc and {_room(num, den)}"))


def crossed(fronts: DataFrame, found: DataFrame | None, num: int, den: int, name: str) -> DataFrame:
    """Pairs (x, y) of each shingle's sets in different classes that have room for a link."""
    members = _classed(fronts, found)
    by_class = members.groupBy("s", "component").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    most = by_class.groupBy("s").agg(F.max(F.struct("k", "component"))["component"].alias("most"), F.count("*").alias("classes"), F.min("least").alias("least")).where("classes > 1").drop("classes")
    # a set needs room beside the smallest set of the group at least
    mixed = scratch(members.join(most, "s").where(f"{num + den} * rem >= {num} * (n + least)"), name)
    return _pairs(_side(mixed.where("component <> most"), "x").join(_side(mixed, "y"), "s").where(f"xc <> yc and {_room(num, den)}"))
