import random
import string
from collections import defaultdict

from massloom.llm import line_dedup as d

from .conftest import prose


def shingles(x):
    out, at = set(), 0
    for word in x.split(" "):
        out |= {x[at + j : at + j + d.SHINGLE] for j in range(0, len(word) + 1, d.SHINGLE)} - {""}
        at += len(word) + 1
    return out


def brute(docs):
    """Kept texts by plain comparison of all lines."""
    where = defaultdict(list)
    for i, text in docs:
        for n, x in enumerate(text.split("\n")):
            if x.strip():
                where[x].append((i, n))
    lines = list(where)
    sets, root = [shingles(x) for x in lines], list(range(len(lines)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= d.THRESHOLD * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    stays = {}
    for k, x in enumerate(lines):
        stays[find(k)] = min([stays.get(find(k), (10**9, 0)), *where[x]])
    keep = {(find(k), o) for k, x in enumerate(lines) for o in where[x] if stays[find(k)] == o}
    spots = {o for _, o in keep}
    return {i: "\n".join(x for n, x in enumerate(text.split("\n")) if not x.strip() or (i, n) in spots) for i, text in docs}


def test_dedup_matches_brute_force(spark):
    base = [prose(k, 40) for k in range(12)]
    near = [x.replace(x.split()[20], "changed", 1) for x in base[:8]]
    docs = [(1, "\n".join(base[:6])), (2, "\n".join([base[0], near[1], "", "own line of two", near[2]])), (3, "\n".join([near[3], base[7], base[7]])), (4, "\n".join([near[7], "日本語のとても長い行" * 4, base[11]])), (5, "日本語のとても長い行" * 3 + "日本語のちがう長い行")]
    got = {r.doc_id: r.text for r in d.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert "changed" not in got[2] + got[3] + got[4]


def test_signatures_find_near_pairs(spark):
    pairs = []
    for k in range(300):
        ws = prose(k, 60).split()
        other = ws.copy()
        other[7] = other[30] = "changed"
        pairs.append((k, " ".join(ws), " ".join(other)))
    get = lambda c: [d.F.get(d.signature(d.F.col(c)), i) for i in range(len(d.PARTS))]
    df = spark.createDataFrame(pairs, "k int, a string, b string").select("k", "a", "b", d.bands(get("a")).alias("x"), d.bands(get("b")).alias("y"), d.agreement(get("a"), get("b")).alias("same"), d.agreement(get("a"), get("a")).alias("all"))
    rows = [r for r in df.collect() if len(shingles(r.a) & shingles(r.b)) >= 0.8 * len(shingles(r.a) | shingles(r.b))]
    assert sum(any(p == q for p, q in zip(r.x, r.y)) and r.same >= d.AGREE for r in rows) >= 0.97 * len(rows) > 200
    assert {r["all"] for r in rows} == {d.BINS}


def test_samples_are_by_content(spark):
    """The first shingle, and those whose first three characters lie in three classes, whatever stands before them."""
    lines = ["one two three eggs", "x" * 9 + " " + "bacdefghijklmnop", "aaaaaaaaaaaa", " lead  extra tax", "日本語のとても長い行" * 3, "", "b", "e", "https://example.com/8484/0"]
    lower, wide = string.ascii_lowercase, lambda c: ord(c) >= 0x250
    first, second, third = set("acegikmoqsuwy02468"), set("bdfhjlnprtvxz13579"), set(" 01234" + lower[:13])

    def plain(line):
        if len(line) < d.SHINGLE:
            return [line] if line else []
        return [line[i : i + d.SHINGLE] for i in range(len(line) - d.SHINGLE + 1) if i == 0 or all(c.lower() in k or wide(c) for c, k in zip(line[i:], (first, second, third)))]

    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").orderBy("k").select(d.sample(d.F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [plain(x) for x in lines]


def test_recall_by_kind_of_line(spark):
    """Pairs of true similarity 0.8 or more that differ in an address, in long words, in a character, in words or at the end."""
    r = random.Random(11)
    letters, han = string.ascii_lowercase + string.digits, [chr(0x4E00 + k) for k in range(600)]
    some = lambda n, of=letters: "".join(r.choice(of) for _ in range(n))
    text = lambda n: " ".join(some(r.randint(2, 8), "etaoinshrdlucmfwypvbgk") for _ in range(n // 6))
    swap = lambda x: (lambda i: x[:i] + "~" + x[i + 1 :])(r.randrange(len(x)))

    def address():
        p, k = text(330), r.randrange(300)
        return [f"{p[:k]} https://{some(20)} {p[k:]}" for _ in range(2)]

    def long_words():
        p = text(420)
        return [f"{p[:100]} {some(18)} {p[100:300]} {some(18)} {p[300:]}" for _ in range(2)]

    def of(make):
        return lambda: (lambda x: [x, swap(x)])(make())

    kinds = {"address": address, "long words": long_words, "short": of(lambda: text(80)), "prose": of(lambda: text(300)), "hex": of(lambda: some(120, "0123456789abcdef")), "han": of(lambda: some(120, han)), "end": lambda: (lambda x: [x + text(18), x + text(18)])(text(240))}
    every = lambda x: {x[i : i + d.SHINGLE] for i in range(len(x) - d.SHINGLE + 1)}
    docs, kind_of = [], {}
    for kind, make in kinds.items():
        found = 0
        while found < 150:
            x, y = make()
            if x != y and len(every(x) & every(y)) >= d.THRESHOLD * len(every(x) | every(y)):
                docs += [(len(docs), x), (len(docs) + 1, y)]
                kind_of[len(docs) - 1] = kind
                found += 1
    gone = {x.ld__id for x in d.fates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    share = {kind: sum(i in gone for i, k in kind_of.items() if k == kind) / 150 for kind in kinds}
    assert gone <= set(kind_of) and min(share.values()) >= 0.95, share


def test_lines_without_spaces_are_compared_by_all_shingles(spark):
    r = random.Random(5)
    long = ["".join(r.choice(kind) for _ in range(400)) for kind in (string.ascii_letters + string.digits, "日本語のとても長い行漢字中文測試", string.ascii_lowercase)]
    # one character put in front, taken out near the front, and put in the middle
    docs = [(k, x) for k, x in enumerate(long)] + [(10 + k, "#" + x) for k, x in enumerate(long)] + [(20 + k, x[:5] + x[6:]) for k, x in enumerate(long)] + [(30 + k, x[:200] + "#" + x[200:]) for k, x in enumerate(long)]
    # half of each is common, at places where blocks agree
    docs += [(40, long[0][:200] + long[2][:200])]
    got = {x.doc_id: x.text for x in d.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, x in sorted(got.items()) if x] == [0, 1, 2, 40]
    sizes = spark.createDataFrame([("abcdefghijkl",), ("short",), ("x" * 50,)], "x string").select(d.F.size(d.shingles(d.F.col("x")))).collect()
    assert [x[0] for x in sizes] == [3, 1, 1]


def test_near_copies_meet_in_buckets_of_boilerplate(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    common, lines = [word() for _ in range(34)], []
    for _ in range(300):
        own = [word() for _ in range(6)]
        lines.append([" ".join(common[:20] + own[:3] + common[20:] + x) for x in (own[3:], [*own[3:5], word()])])
    docs = [(k, x) for k, (x, _) in enumerate(lines)] + [(1000 + k, y) for k, (_, y) in enumerate(lines)]
    every = lambda x: {x[i : i + d.SHINGLE] for i in range(len(x) - d.SHINGLE + 1)}
    assert all(len(every(x) & every(y)) >= d.THRESHOLD * len(every(x) | every(y)) for x, y in lines)
    assert max(len(every(lines[k][0]) & every(lines[j][0])) / len(every(lines[k][0]) | every(lines[j][0])) for k in range(60) for j in range(k)) < d.THRESHOLD
    got = {x.doc_id: x.text for x in d.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] for k in range(300)) and sum(bool(got[1000 + k]) for k in range(300)) <= 3


def test_signatures_hash_every_shingle(spark):
    """The least hash of each range is that of all shingles, in the expression and in the grouped form, for every script and length."""
    lines = [prose(3, 40), "x" * 30, "short", "日本語のとても長い行" * 4 + "ちがう", "😀" * 5 + "".join(chr(0x1F600 + k) for k in range(40)), "\tone  two\x0b" * 3, " ".join(prose(k, 60) for k in range(8))]
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "ld__id long, ld__no int, ld__line string")
    low = (1 << 32) - 1

    def plain(hashes, n):
        ranges = [[x & low for x in hashes if x >> 60 == k and x & low < (d.SPARE * d.BINS << 32) / max(n - d.SHINGLE, 1)] for k in range(-8, 8)]
        least = [min(r, default=None) for r in ranges]
        return [next(x for x in least[k:] + least[:k] if x is not None) for k in range(16)]

    rows = df.select("ld__id", "ld__line", d.shingles(d.F.col("ld__line")).alias("all"), d.signature(d.F.col("ld__line")).alias("g")).collect()
    grouped = {r.place >> 31: r for r in d.signatures(df).selectExpr("cast(place as long) place", "n", *d.PARTS).collect()}
    for r in rows:
        x = r.ld__line
        assert len(r.all) == len({x[i : i + d.SHINGLE] for i in range(max(1, len(x) - d.SHINGLE + 1))})
        halves = [h for p in r.g for h in (p & low, p >> 32 & low)]
        assert halves == plain(r.all, len(x)), x
        assert [grouped[r.ld__id][g] for g in d.PARTS] == list(r.g) and grouped[r.ld__id].n == 1


def test_a_shingle_is_hashed_once_and_folded_without_decimals(spark):
    df = spark.createDataFrame([(1, 0, "a line of some words")], "ld__id long, ld__no int, ld__line string")
    plan = d.signatures(df)._jdf.queryExecution().optimizedPlan().toString()
    folds = [x for x in plan.splitlines() if "Aggregate" in x]
    assert plan.count("substring(") == 1 and len(folds) == 2 and "decimal" not in next(x for x in folds if "CASE WHEN" in x), plan


def test_lines_of_blanks_stay(spark):
    # other spaces than the contracts' are words
    blank = [" ", "\t \x0b\x0c\r", "\xa0 \xa0", "\x1c\x1c"]
    docs = [(1, "\n".join(blank)), (2, "\n".join(blank)), (3, None), (4, "")]
    got = {x.ld__id: x.ld__gone for x in d.fates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2: [2, 3]}
