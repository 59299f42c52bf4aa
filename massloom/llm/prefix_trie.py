"""Prefix tries of conversations: which conversations begin alike, and what sharing those beginnings would save.

Names by prefix doubling: level 0 names every turn by its role and text, level k every aligned block of 2^k turns by the
names of its halves, so a conversation of n turns has fewer than 2n blocks and all levels take log2(n) rounds. A prefix of
d turns is the blocks of d's binary digits in a row, longest first: the prefix without its last block is named a round
before, so that prefixes whose length has r digits 1 are named in round r, by (length, that prefix's name, last block's
name). Names are dense integers over the distinct combinations of a round, numbered within hash buckets.

Then nodes are groups of (length, name). A node's smallest member tells it from all others of its depth, so from there on
(depth, smallest member) stands for the name. No round looks at pairs of conversations: a turn that a third of all
conversations share is one name, its rows are counted before the shuffle, and the joins that give rows their names are
equi joins with one row a name, which adaptive execution may split. Sums along a conversation go by chunks of CHUNK turns,
so that one conversation may hold most of the table. Members' ids are joined in chunks of 2^ID_BITS values and hashed as a
stream: no list of all members stands anywhere. Every round ends in a table in the shared folder.

Edge cases: a null role or text is empty. Turns are ordered by turn (null first), ties by role and text; repeated rows are
turns of their own. Rows without conv_id belong to no conversation. A conversation without turns ends at the root. An empty
table has no nodes. Long texts are compared by their SHA-256 digest with role and length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, scratch, words

#: Turns of a conversation that one window takes; beyond, chunks are summed first.
CHUNK = 1024
#: Ids of members are joined into strings of 2^ID_BITS values at most.
ID_BITS = 8
#: Conversations of one family start with the turns of the first of them.
FAMILY = 20
MOST_SHARED = 4


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns with their place in the conversation, from 0."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(1 << 62))))
    inside = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(sizes.select("conv_id", "chunk", before.alias("before")), ["conv_id", "chunk"]).select("conv_id", (F.col("inside") + F.col("before")).alias("place"), "role", "text")


def family_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): every conversation c begins with the first h turns of c - c % FAMILY, then come its own
    after its first h, h being crc32(c) % MOST_SHARED. turns: numbered()."""
    head, shared = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED - 1)).withColumnRenamed("conv_id", "head")
    each = turns.select("conv_id").distinct().select("conv_id", head.alias("head"), shared.alias("h"))
    taken = each.join(heads, "head").where("place < h").select("conv_id", "place", "role", "text")
    lengths = heads.groupBy("head").agg(F.count("*").alias("length"))
    own = turns.withColumns({"head": head, "h": shared}).where("place >= h").join(lengths, "head", "left")
    return taken.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))).alias("place"), "role", "text"))


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with name: a dense integer, from 0, of each distinct combination of keys; the keys go.

    Combinations are numbered within hash buckets; a table of one row a bucket says where each starts.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    within = scratch(distinct.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))), "trie-names")
    sizes = within.groupBy("bucket").agg(F.max("n").alias("size"))
    start = sizes.select("bucket", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ids = within.join(F.broadcast(start), "bucket").select(*keys, (F.col("start") + F.col("n") - 1).alias(name))
    out = scratch(rows.join(ids, keys).drop(*[k for k in keys if k != "depth"]), f"trie-{name}")
    drop(within)
    return out


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Level k: (conv_id, j, block, last): the name of turns [j 2^k, (j + 1) 2^k), and the words of the last of them."""
    identity = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = turns.select("conv_id", F.col("place").alias("j"), identity.alias("a"), F.size(words(F.col("text"))).cast("long").alias("last"))
    levels = [_named(rows, ["a"], "block")]
    while 2 << (len(levels) - 1) <= longest:
        odd = F.col("j") % 2 == 1
        halves = levels[-1].groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(F.max(F.when(~odd, F.col("block"))).alias("a"), F.max(F.when(odd, F.col("block"))).alias("b"), F.max(F.when(odd, F.col("last"))).alias("last"))
        levels.append(_named(halves.where("a is not null and b is not null"), ["a", "b"], "block"))
    return levels


def _prefixes(levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name, last): the name of every prefix among those of its depth."""
    parts = [b.where("j % 2 = 0").select("conv_id", (F.col("j") * (1 << k)).alias("start"), ((F.col("j") + 1) * (1 << k)).alias("depth"), "block", "last") for k, b in enumerate(levels)]
    used = parts[0]
    for part in parts[1:]:
        used = used.unionByName(part)
    named = [used.where("start = 0").select("conv_id", "depth", F.col("block").alias("name"), "last")]
    for digits in range(2, len(levels) + 1):
        shorter = named[-1].select("conv_id", F.col("depth").alias("start"), F.col("name").alias("shorter"))
        longer = used.where(F.bit_count("depth") == digits).join(shorter, ["conv_id", "start"]).select("conv_id", "depth", "shorter", "block", "last")
        named.append(_named(longer, ["depth", "shorter", "block"], "name"))
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out


def _sums_to_end(chain: DataFrame, value: Column) -> DataFrame:
    """chain with rest: the sum of value over this and all later depths of the conversation."""
    rows = chain.withColumns({"chunk": F.floor(F.col("depth") / CHUNK), "value": value})
    totals = rows.groupBy("conv_id", "chunk").agg(F.sum("value").alias("total"))
    later = F.coalesce(F.sum("total").over(Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("value").over(Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(totals.select("conv_id", "chunk", later.alias("later")), ["conv_id", "chunk"]).withColumn("rest", F.col("inside") + F.col("later")).drop("chunk", "value", "inside", "later")


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's strings in a row, comma-joined; rows come sorted by node."""
    node, digest = None, None
    for batch in batches:
        out = []
        for depth, first, ids in zip(batch["depth"], batch["first"], batch["ids"], strict=True):
            if node != (depth, first):
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, first), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "first", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "first", "ends_sha256"])


def hash_members(members: DataFrame) -> DataFrame:
    """(depth, first, ends_sha256) of (depth, first, conv_id): ids in numeric order, comma-joined, hashed as a stream."""
    chunks = members.groupBy("depth", "first", F.shiftright("conv_id", ID_BITS).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition("depth", "first").sortWithinPartitions("depth", "first", "chunk").select("depth", "first", "ids")
    return ordered.mapInPandas(_hash_rows, "depth long, first long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Nodes of the trie of turns (conv_id, place from 0, role, text), the root without a turn included:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: (conv_id), distinct, for those that may have no turn; without it, those of turns.
    """
    turns = scratch(turns, "trie-turns")
    everyone = scratch(turns.select("conv_id").distinct() if conversations is None else conversations.select("conv_id"), "trie-conversations")
    longest = turns.agg(F.max("place")).first()[0]
    levels = _blocks(turns, 1 + (-1 if longest is None else longest))
    prefixes = _prefixes(levels)
    groups = prefixes.groupBy("depth", "name").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.max("last").alias("last"))
    chain = scratch(prefixes.join(groups.drop("last"), ["depth", "name"]).select("conv_id", "depth", "first", "n_convs", "last"), "trie-chain")

    # a node is the row of its smallest member; its parent is the same conversation's row of a turn less
    top = F.lit(everyone.agg(F.min("conv_id")).first()[0]).cast("long")
    above = chain.select(F.col("conv_id").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("above"))
    parent = F.when(F.col("depth") == 1, top).otherwise(F.col("above")).alias("parent_conv_id")
    root = everyone.agg(F.lit(0).cast("long").alias("depth"), F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.lit(None).cast("long").alias("parent_conv_id")).where("n_convs > 0")
    owned = chain.where("conv_id = first").select("depth", "first", "n_convs").join(above, ["depth", "first"], "left")
    nodes = scratch(owned.select("depth", "first", "n_convs", parent).unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("first")).agg(F.count("*").alias("n_children"))
    # a leaf's members all end there, so its smallest member is the first of one leaf alone
    leaves = nodes.where("depth > 0").join(children, ["depth", "first"], "left_anti").select(F.col("first").alias("conv_id"), F.lit(1).alias("leaf"))
    saved = F.when(F.col("conv_id") == F.col("first"), (F.col("n_convs") - 1) * F.col("last")).otherwise(0)
    below = scratch(
        _sums_to_end(chain, saved).join(leaves, "conv_id", "left").groupBy("depth", "first").agg(F.sum("rest").alias("saved_tokens"), F.count("leaf").alias("n_leaves")), "trie-below"
    )
    whole = below.where("depth = 1").agg(F.lit(0).cast("long").alias("depth"), top.alias("first"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    below = below.unionByName(whole)
    lengths = everyone.join(prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth")), "conv_id", "left")
    ends = lengths.where("depth is not null").join(chain.select("conv_id", "depth", "first"), ["conv_id", "depth"]).select("depth", "first", "conv_id")
    ends = ends.unionByName(lengths.where("depth is null").select(F.lit(0).cast("long").alias("depth"), top.alias("first"), "conv_id"))
    on = ["depth", "first"]
    return (
        nodes.join(children, on, "left").join(below, on, "left").join(hash_members(ends), on, "left")
        .select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn; the root has none."""
    last = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = scratch(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "trie-original")
    return prefix_trie(family_heads(turns), turns.select("conv_id").distinct())
