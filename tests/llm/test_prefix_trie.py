"""The trie against a plain one of nested tuples."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from massloom import llm
from massloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, depth long, first long, name string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for s in sorted(members, key=len, reverse=True):
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = leaves.get(s, 0) or 1
        saved[s] = saved.get(s, 0) + (len(members[s]) - 1) * n_words
        if s:
            for table, more in ((children, 1), (leaves, leaves[s]), (saved, saved[s])):
                table[s[:-1]] = table.get(s[:-1], 0) + more
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def run(spark, folder, rows, files=3):
    spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(files).write.parquet(f"{folder}/conversations.parquet")
    got = llm.queries()["op11_prefix_trie"](spark, str(folder))
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def talks(seed, count, most):
    r = random.Random(seed)
    return [(c, k, r.choice(["user", "assistant"]), r.choice(["", "yes", "no it is", "what  else\n?"])) for c in r.sample(range(-40, 40 * count), count) for k in range(r.randint(1, most))]


@pytest.mark.parametrize("seed, most", [(1, 6), (2, 3), (3, 17)])
def test_random_conversations(spark, tmp_path, seed, most):
    rows = talks(seed, 60, most)
    assert run(spark, tmp_path, rows) == expected(rows)


def test_odd_conversations(spark, tmp_path):
    same = [("user", "hello you"), ("assistant", "hi"), ("user", "bye")]
    rows = [(c, k, *t) for c in range(100, 170) for k, t in enumerate(same)]
    rows += [(7, None, None, "null first"), (7, 0, "user", None), (7, 1, "user", "a b"), (7, 1, "user", "a b"), (7, 1, "assistant", "tie")]
    rows += [(None, 0, "user", "of no conversation"), (8, None, None, None), (9, 5, "", ""), (40, 0, "user", ""), (-3, 2, "user", "x" * 50_000 + " " + "y " * 20_000)]
    got = run(spark, tmp_path, rows)
    assert got == expected(rows)
    # one within its own first turns whose family has no head has no turn left
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in got)


def test_a_long_conversation_goes_by_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    r = random.Random(4)
    long = [(c, k, "user", r.choice(["go on", "and then"]) if k > 90 else f"step {k}") for c in (20, 21, 22, 55) for k in range(150)]
    assert run(spark, tmp_path, long) == expected(long)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_members_are_hashed_in_numeric_order_over_many_chunks(spark):
    ids = [-5, 3, 20, 100, 9, 255, 256, 257, 10**12, 5_000, *range(600, 1_400, 3)]
    rows = spark.createDataFrame([(2, 9, i) for i in ids] + [(1, 9, 4)], "depth long, first long, conv_id long").repartition(4)
    got = {(r.depth, r.first): r.ends_sha256 for r in prefix_trie.hash_members(rows).select("depth", F.col("first"), "ends_sha256").collect()}
    assert got == {(2, 9): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 9): hashlib.sha256(b"4").hexdigest()}


def test_real_outputs_have_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")], "conv_id long, place long, role string, text string")
    got = prefix_trie.with_turns(prefix_trie.prefix_trie(turns), turns).collect()
    assert {(r.conv_id, r.depth): (r.role, r.text, r.n_convs) for r in got} == {(1, 0): (None, None, 2), (1, 1): ("user", "a", 2), (1, 2): ("bot", "b", 1)}
