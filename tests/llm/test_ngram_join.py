import random
import re

import numpy as np
import pyarrow as pa
import pytest

from massloom.llm import ngram_join as j

from .conftest import WORDS, prose


def shingles(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, n, copies, edits):
    r, out = random.Random(seed), []
    ws = prose(seed, n).split()
    for _ in range(copies):
        x = ws.copy()
        for _ in range(r.randint(0, edits)):
            x[r.randrange(len(x))] = r.choice(WORDS)
        out.append(" ".join(x))
    return out


def test_classes_match_brute_force(spark):
    texts, passage = [], prose(777, 60)
    for seed, (n, copies, edits) in enumerate([(6, 12, 1), (9, 12, 1), (12, 12, 2), (30, 20, 3), (80, 30, 6), (200, 12, 12), (600, 6, 20)]):
        texts += family(seed, n, copies, edits)
    texts += [f"{prose(k, 20)} {passage} {prose(k + 1000, 25)}" for k in range(150)]
    texts += [passage.upper(), passage, " " + passage, "one", "ONE", "one two three four", "", None, " \n"]
    random.Random(5).shuffle(texts)
    docs = list(enumerate(texts, 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("common, others, spread", [(115, 400, 1), (212, 60, 1), (115, 400, 2), (40, 120, 7), (60, 90, 211)])
def test_links_do_not_depend_on_files(spark, common, others, spread):
    """A passage is hot in one file and rare in another: what two documents share is counted over all of them."""
    passage = " ".join(f"p{i}" for i in range(common + 4))
    own = [f"own{i}" for i in range(200)]
    one = [(1, f"{passage} {' '.join(own[: common // 6])}"), (2, f"{passage} {' '.join(own[: common // 6 - 6])} {' '.join(own[100:106])}")]
    many = [(10 + k, f"{prose(k, common)} {passage} {prose(k + 5000, 30)}") for k in range(others)]
    near = [(5000 + k, x) for k, x in enumerate(family(common, common, 40, common // 12))]
    expected = brute([*one, *many, *near])
    assert expected[2][1] == 1
    split = spark.createDataFrame([one[0], *many, *near], "doc_id long, text string").coalesce(1)
    split = split.unionByName(spark.createDataFrame([one[1]], "doc_id long, text string").coalesce(1))
    docs = split if spread == 1 else split.repartition(spread)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(docs).collect()}
    assert got == expected


def test_hotness_does_not_depend_on_flushes():
    """Members of a hot token are the same whether one flush, several or none sees it as hot."""
    texts = family(3, 120, 60, 2) + [f"{prose(k, 30)} {prose(9, 40)}" for k in range(40)]
    ids = pa.array(range(len(texts)), pa.int64())

    def hot_and_cold(cuts):
        rows = [j._emit(3)([pa.RecordBatch.from_arrays([ids[a:b], pa.array(texts[a:b])], ["id", "text"])]) for a, b in zip([0, *cuts], [*cuts, len(texts)])]
        table = pa.Table.from_batches([b for r in rows for b in r])
        out = [j._reduce(table.filter(pa.compute.equal(table.column("bucket"), k))) for k in sorted(set(table.column("bucket").to_pylist()))]
        found = {True: set(), False: set()}
        for r in pa.concat_tables(out).to_pylist():
            found[r["hot"]] |= {(r["token"], i, k < r["n_own"]) for k, i in enumerate(r["ids"])}
        return found

    whole = hot_and_cold([])
    assert whole[True] and whole[False]
    for cuts in ([50], [3, 97], list(range(1, len(texts)))):
        assert hot_and_cold(cuts) == whole


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 11, 14, 18, 40, 97, 300, 900])
def test_linked_sets_share_an_entry(n):
    """The pigeonhole: sets on the edge of linking meet, under plain segments, neighbourhoods, or both prefixes."""
    r, texts, pairs = random.Random(n), [], []
    for k in range(60):
        common = [f"w{k}x{i}" for i in range(n + 4)]
        lose = int(r.random() * (n // 4 + 1))
        tail = common[: len(common) - lose]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(common), " ".join(tail)]
    s = j.Sets(pa.array(texts))
    token, text, own = s.entries()
    by = [set() for _ in texts]
    for t, i in zip(token.tolist(), text.tolist()):
        by[i].add(t)
    checked = 0
    for a, b in pairs:
        common = len(np.intersect1d(s.set(a), s.set(b)))
        if j.jaccard_links(common, int(s.sizes[a]), int(s.sizes[b])):
            checked += 1
            assert by[a] & by[b]
    assert checked


def test_plans_cover_what_linked_sets_differ_in():
    edges = j.bands(5000)
    plans = [j.plan(int(a), int(b - 1)) for a, b in zip(edges, edges[1:])]
    assert any(n1 for _, n1 in plans)  # neighbourhoods are chosen where they are cheaper
    for (m, n1), high in zip(plans, edges[1:]):
        assert m + n1 > 0 and m <= 2 * j.may_differ(int(high), 4 * int(high) // 3) + 4


def test_hot_groups_stay_with_the_mapper():
    texts = family(3, 120, 300, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["id", "text"])
    out = pa.Table.from_batches(list(j._emit(4)([batch])))
    hot = out.filter(pa.compute.less(out.column("bucket"), 0))
    assert hot.num_rows and max(map(len, hot.column("ids").to_pylist())) <= j.CHUNK
    one = out.filter(pa.compute.equal(out.column("bucket"), 0))
    groups = j._reduce(one)
    assert set(groups.column_names) == {"token", "leader", "ids", "n_own", "size", "hot"}


def test_histograms_never_refute_a_link():
    texts = family(11, 300, 30, 25) + family(12, 1015, 20, 30) + [" ".join(f"w{i}" for i in range(n)) for n in (900, 1000, 1004, 1010, 1100)]
    s = j.Sets(pa.array(texts))
    h, linked = s.histograms().to_pylist(), set()
    for a in range(len(texts)):
        for b in range(a):
            common = len(np.intersect1d(s.set(a), s.set(b)))
            differ = j.least_difference(h[a], h[b])
            assert differ <= int(s.sizes[a]) + int(s.sizes[b]) - 2 * common
            if j.jaccard_links(common, int(s.sizes[a]), int(s.sizes[b])):
                linked.add((len(h[a]), len(h[b])))
                assert differ <= j.may_differ(int(s.sizes[a]), int(s.sizes[b]))
    assert (j.HIST, j.FINE) in linked or (j.FINE, j.HIST) in linked


def test_a_mapper_holds_little():
    """Before, 116 MB of arrays here, in each of an executor's workers."""
    import random
    import tracemalloc

    import pyarrow as pa
    from massloom.llm import ngram_join as join

    r = random.Random(1)
    words = [f"w{k}" for k in range(20_000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    try:
        sent = sum(sum(len(x.as_py()) for x in b.column("entries") if x.is_valid) // 10 for b in join._emit(64)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 1_200_000 and peak < 90e6, (sent, peak)
