"""N-gram Jaccard self-join by the pigeonhole over a partitioned universe, exact, with classes of linked documents.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two sets of Jaccard similarity 3/4 or more differ in
at most a seventh of their joint sizes. Shingles are hashed into m segments; if the segments that a set fills are worth
more points than the sets may differ in, one of them must agree. A plain segment is worth one point and is indexed by
the hash of its subset; a segment with one-deletion neighbourhoods (of two shingles or more) is worth two and is indexed
by its subset and by every subset with one shingle left out. plan() allocates segments and neighbourhoods for each size
band by cost: entries written, and collisions to be expected from small subsets.

Size bands grow by 4/3, so a pair lies in one band or in two neighbours: a document is indexed under its own band's
scheme and the one below. A document whose segments are worth too few points (chance empties them) also indexes a prefix
of its sorted set, the classic prefix filter, so pairs of two such documents meet there.

Work and exactness under skew:
- Exact copies of a set are one set from the start, by its 128-bit hash.
- Entries travel packed, 10 bytes each, in rows of one bucket and flush. A token that HOT or more sets share anywhere is
  hot, for all of its sets alike: a mapper that sees so many of them keeps its members in rows of their own and sends a
  marker to the token's bucket, which then counts its other members as hot too. So no bucket holds a large group, and
  hotness depends neither on files nor on flushes.
- Groups that are not hot compare with their leader (a star), links make classes, and then all pairs of a group in
  different classes are compared, fewer than HOT ** 2 / 2 a group.
- Hot groups compare nothing. A set is short if the hot tokens that it lost are worth more points than it has to spare.
  A linked pair with one set that is not short still shares a token that is not hot, so it has met already. Pairs of two
  short sets (families of near copies, documents that are mostly a common passage) meet by a prefix filter over the short
  sets alone, rarest shingles first: with rem shingles from the first common one on, rem of both must reach 3/7 of the
  joint sizes. A passage's shingles come last in that order, so sets that share but a passage hardly meet. Leaders link
  families first (the least changed set of each shingle's group, then others), and what then lies in different classes
  and passes the filter is compared by pairs. A shingle's largest class is never paired with itself.
- Before a candidate pair's texts are fetched, sizes and histograms must allow a link: each set keeps counts of its
  shingles in HIST parts of the universe, and sets differ in at least the sum of the counts' differences. That bound is
  exact and refutes nearly all pairs that share but a passage. What is left is verified on the texts, exactly.

Edge cases: texts without words (null, empty, blank) have n_shingles 0 and link with nothing; 1 to 4 words are one
shingle; rows that repeat an id share its class; a null id has the class of equal sets, else null; an empty table gives
an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefixes
from .common import connected_components, drop, scratch
from .textnum import distinct, flat, hash_spans, lower, mix, pieces, windows, word_spans

WIDTH = 5
#: The similarity of linked sets, as a fraction.
LINKED = (3, 4)
#: Sets in a group from which on it is hot.
HOT = 16
#: Rounds of leaders among short sets before pairs of different classes are compared; a round without a link ends them.
ROUNDS = 3
#: Entries a mapper holds before it writes them out (with what sorts them some 100 bytes each, in every worker of an executor),
#: and entries meant for a bucket.
FLUSH = 400_000
BUCKET = 1_500_000
CHUNK = 1000
#: Bytes of text that a mapper looks at at once, or one text.
PIECE = 1 << 20
#: What an expected one-shingle subset costs, in entries, and the points kept beyond need.
COLLISION = 2.0
SPARE = 0.12

#: Parts of the universe in the histogram of a set, and in that of a set over LARGE, which folds to the other; a count
#: stops at 255.
HIST, FINE, LARGE = 128, 1024, 1000

BITS = 39
#: Stands for a hot token in its bucket; ids of sets begin at 1.
MARKER = 0
U = np.uint64


def jaccard_links(common, a, b):
    """Whether sets of sizes a and b with so many common elements link: 100 * intersection >= 75 * union."""
    return 100 * common >= 75 * (a + b - common)


@lru_cache
def bands(most: int) -> np.ndarray:
    """Least sizes of the bands, up to one beyond most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, 4 * (out[-1] - 1) // 3 + 1))
    return np.array([*out, max(out[-1] + 1, 4 * (out[-1] - 1) // 3 + 1)], np.int64)


def may_differ(a, b):
    """The most elements in which linked sets of sizes a and b differ."""
    return (a + b) // 7


@lru_cache(maxsize=4096)
def plan(low: int, high: int) -> tuple[int, int]:
    """(segments, how many of them with one-deletion neighbourhoods) for sizes low to high of the smaller set."""
    best, chosen = math.inf, (may_differ(high, 4 * high // 3) + 1, 0)
    need = {s: may_differ(s, 4 * s // 3) + 1 for s in (low, high)}
    top = 2 * need[high] + 2
    for m in sorted({max(1, round(x)) for x in np.linspace(1, top, min(top, 160))}):
        for n1 in sorted({0, m // 8, m // 4, m // 2, m}):
            cost, ok = 0.0, True
            for s, k in need.items():
                x = s / m
                empty, single = math.exp(-x), x * math.exp(-x)
                points = m * (1 - empty) + n1 * (1 - empty - single)
                ok &= points >= k * (1 + SPARE) if k > 4 else points >= k * 0.8
                cost += m * (1 - empty) + n1 * (x - single) + COLLISION * m * single
            if ok and cost < best:
                best, chosen = cost, (m, n1)
    return chosen


@lru_cache(maxsize=64)
def _schemes(n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    edges = bands(10)
    while len(edges) < n_bands + 2:
        edges = bands(int(edges[-1]))
    got = [plan(int(edges[k]), int(edges[k + 1] - 1)) for k in range(n_bands)]
    return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)


class Sets:
    """Sorted distinct shingle hashes of texts: text and value of each, sizes, and the sets' 128-bit hashes."""

    def __init__(self, column: pa.Array):
        data, bounds = flat(column)
        starts, ends, counts = word_spans(data, bounds)
        hashes = hash_spans(lower(data), starts, ends)
        self.n = len(counts)
        text, _, values = windows(hashes, counts, WIDTH, short=True)
        self.text, self.values = distinct(text, values, self.n)
        self.sizes = np.bincount(self.text, minlength=self.n).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = [self._sum(mix(self.values + U(c))) for c in (0x51, 0xA7)]
        self.ids = [mix(x + self.sizes.astype(U)) for x in self.ids]

    def _sum(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
        return sums[self.first + self.sizes] - sums[self.first]

    def set(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i] + self.sizes[i]]

    def histograms(self) -> pa.Array:
        width = np.where(self.sizes > LARGE, FINE, HIST)
        base = np.concatenate([[0], np.cumsum(width)])
        counts = np.bincount(base[self.text] + (self.values % width[self.text].astype(U)).astype(np.int64), minlength=int(base[-1]))
        data = np.minimum(counts, 255).astype(np.uint8)
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(data)])

    def band(self) -> np.ndarray:
        return np.searchsorted(bands(int(self.sizes.max(initial=1))), self.sizes, "right") - 1

    def _segments(self, scheme: np.ndarray):
        """Of each text's scheme (-1: none): elements, their segment keys, and segments' counts, owners, numbers, n1."""
        ms, n1s = _schemes(int(scheme.max(initial=0)) + 1)
        m, n1 = np.where(scheme >= 0, ms[scheme], 0), np.where(scheme >= 0, n1s[scheme], 0)
        base = np.cumsum(m) - m
        use = np.flatnonzero((scheme >= 0)[self.text])
        text = self.text[use]
        place = ((mix(self.values[use] + U(0xC3)) >> U(32)) * m[text].astype(U)) >> U(32)
        key = base[text] + place.astype(np.int64)
        count = np.bincount(key, minlength=int(m.sum()))
        owner = np.repeat(np.arange(self.n), m)
        number = np.arange(len(owner)) - base[owner]
        return use, key, count, owner, number, number < n1[owner]

    def spare(self, scheme: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Points of each text beyond those that it needs, in hot groups that it can lose; large where it has no scheme."""
        _, _, count, owner, _, pair = self._segments(scheme)
        points = np.bincount(owner, (count > 0) + (pair & (count > 1)), minlength=self.n).astype(np.int64)
        weight = np.where(np.bincount(owner, pair, minlength=self.n) > 0, 2, 1)
        return np.where(scheme >= 0, (points - differ - 1) // weight, 1 << 30)

    def both_spares(self) -> tuple[np.ndarray, np.ndarray]:
        k = self.band()
        own = self.spare(np.where(self.sizes > 0, k, -1), may_differ(self.sizes, 4 * self.sizes // 3))
        lower_most = bands(int(self.sizes.max(initial=1)))[np.maximum(k, 0)] - 1
        low = self.spare(np.where((self.sizes > 0) & (k > 0), k - 1, -1), may_differ(self.sizes, np.minimum(self.sizes, lower_most)))
        return own, low

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index entries of all texts: token, text, and whether it is under the text's own band."""
        k, tokens, texts, owns = self.band(), [], [], []
        for own, scheme in ((True, np.where(self.sizes > 0, k, -1)), (False, np.where((self.sizes > 0) & (k > 0), k - 1, -1))):
            use, key, count, owner, number, pair = self._segments(scheme)
            part = mix(self.values[use] + U(0x1D))
            sums = np.zeros(len(count), U)
            np.add.at(sums, key, part)
            salt = mix(number.astype(U) + (scheme[owner].astype(U) << U(32)) + U(0xF1))
            some = np.flatnonzero(count > 0)
            tokens.append(mix(sums[some] + salt[some]))
            texts.append(owner[some])
            less = np.flatnonzero((pair & (count > 1))[key])
            tokens.append(mix(sums[key[less]] - part[less] + salt[key[less]]))
            texts.append(owner[key[less]])
            owns.append(np.full(len(some) + len(less), own))
        a, b = self.both_spares()
        short = np.flatnonzero((self.sizes > 0) & ((a < 0) | (b < 0)))
        for i in short.tolist():
            n = int(self.sizes[i])
            prefix = self.set(i)[: n - -(-3 * n // 4) + 1]
            tokens.append(mix(prefix + U(0xEE)))
            texts.append(np.full(len(prefix), i))
            owns.append(np.full(len(prefix), True))
        return np.concatenate(tokens), np.concatenate(texts), np.concatenate(owns)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            s = Sets(part.column("text"))
            own, low = s.both_spares()
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s.sizes), *[pa.array(x.view(np.int64)) for x in s.ids], pa.array(np.minimum(own, 1 << 30).astype(np.int32)), pa.array(np.minimum(low, 1 << 30).astype(np.int32)), s.histograms()], ["id", "n", "a", "b", "own_spare", "low_spare", "hist"])


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unfive(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :5] = x
    return out.view("<u8").ravel()


ENTRIES = "bucket int, entries binary, token long, leader long, ids array<long>, n_own int"
GROUPS = "token long, leader long, ids array<long>, n_own int, size int, hot boolean"


def _group_rows(token: np.ndarray, ids: np.ndarray, own: np.ndarray, least: int = 1):
    """Rows of GROUPS, CHUNK ids at most in each, of entries sorted by (token, not own, id), each (token, id) once.

    The leader is the least id of the group's own band. Groups of least sets or fewer, and, if least is 1, those without
    a set of the own band, hold no pair and are left out.
    """
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(token)))
    n_own = np.add.reduceat(own.astype(np.int64), first) if len(first) else size
    keep = (size > least) & (n_own >= least)
    rows = []
    for f, n, k in zip(first[keep].tolist(), size[keep].tolist(), n_own[keep].tolist()):
        for c in range(0, n, CHUNK):
            rows.append((f, f + c, min(CHUNK, n - c), min(max(k - c, 0), CHUNK), n))
    r = np.array(rows, np.int64).reshape(-1, 5)
    at = np.repeat(r[:, 1], r[:, 2]) + (np.arange(int(r[:, 2].sum())) - np.repeat(np.cumsum(r[:, 2]) - r[:, 2], r[:, 2]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(r[:, 2])]).astype(np.int32)), pa.array(ids[at].astype(np.int64)))
    return r, pa.array(token[r[:, 0]].astype(np.int64)), pa.array(ids[r[:, 0]].astype(np.int64)), lists


def _emit(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, owns, held, seen, flushes = [], [], [], 0, set(), 0

        def out() -> Iterator[pa.RecordBatch]:
            token, id40, own = np.concatenate(tokens), np.concatenate(ids), np.concatenate(owns)
            for held_list in (tokens, ids, owns):
                held_list.clear()
            bucket = (((token >> U(32)) * U(n_buckets)) >> U(32)).astype(np.int64)
            token = (bucket.astype(U) << U(BITS)) | (token & U((1 << BITS) - 1))
            order = np.argsort(token)
            token, id40, own, bucket = token[order], id40[order], own[order], bucket[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))
            send = np.ones(len(token), bool)
            hot = np.repeat(size >= HOT, size)
            if hot.any():
                at = np.flatnonzero(hot)
                at = at[np.lexsort((id40[at], ~own[at], token[at]))]
                r, t, leader, lists = _group_rows(token[at], id40[at], own[at], 0)
                n = len(r)
                key = pa.array(-1 - (np.arange(n) + flushes * 7919 + int(token[0] % U(65521))) % n_buckets, pa.int32())
                yield pa.RecordBatch.from_arrays([key, pa.nulls(n, pa.binary()), t, leader, lists, pa.array(r[:, 3].astype(np.int32))], ["bucket", "entries", "token", "leader", "ids", "n_own"])
                # one marker tells the bucket that the token is hot
                new = at[np.append(True, token[at][1:] != token[at][:-1])]
                send[hot] = False
                send[new], id40[new] = True, MARKER
            token, id40, own, bucket = token[send], id40[send], own[send], bucket[send]
            packed = np.hstack([_five(((token & U((1 << BITS) - 1)) << U(1)) | own.astype(U)), _five(id40)])
            used, cut = np.unique(bucket, return_index=True)
            cut = np.append(cut, len(bucket))
            none = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.int32())], ["bucket", "entries", "token", "leader", "ids", "n_own"])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                s = Sets(part.column("text"))
                token, text, own = s.entries()
                fresh = np.zeros(s.n, bool)
                for i, x in enumerate(s.ids[0].tolist()):
                    if x not in seen and part.column("id")[i].is_valid:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[text]
                tokens.append(token[keep])
                ids.append(np.maximum(s.ids[0] >> U(24), U(MARKER + 1))[text[keep]])
                owns.append(own[keep])
                held += int(keep.sum())
                if held >= FLUSH:
                    yield from out()
                    held, seen, flushes = 0, set(), flushes + 1
        if held:
            yield from out()

    return run


def _reduce(table: pa.Table) -> pa.Table:
    """All entries of one bucket to its groups; rows of a mapper's hot groups pass."""
    names = ["token", "leader", "ids", "n_own", "size", "hot"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_()]
    if table.column("bucket")[0].as_py() < 0:
        n = table.num_rows
        return pa.table([table.column(c) for c in names[:4]] + [pa.array(np.full(n, HOT, np.int32)), pa.array(np.ones(n, bool))], names)
    packed = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for c in table.column("entries").chunks for x in c]).reshape(-1, 10)
    head = _unfive(packed[:, :5])
    token = head >> U(1)
    order = np.argsort(token)
    token, same = token[order], np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    token, own, ids = token[same], (head[order] & U(1)).astype(bool), _unfive(packed[order, 5:])
    order = np.lexsort((ids, ~own, token))
    token, own, ids = token[order], own[order], ids[order]
    new = np.append(True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])) if len(token) else np.zeros(0, bool)
    token, own, ids = token[new], own[new], ids[new]
    token = token | (U(table.column("bucket")[0].as_py()) << U(BITS))
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(token)))
    marked = np.add.reduceat((ids == U(MARKER)).astype(np.int64), first) if len(first) else size
    is_hot, real = np.repeat((size >= HOT) | (marked > 0), size), ids != U(MARKER)
    out = []
    for hot in (False, True):
        at = (is_hot == hot) & real
        r, t, leader, lists = _group_rows(token[at], ids[at], own[at], int(not hot))
        out.append(pa.table([t, leader, lists, pa.array(r[:, 3].astype(np.int32)), pa.array(r[:, 4].astype(np.int32)), pa.array(np.full(len(r), hot))], names).cast(pa.schema(list(zip(names, kinds)))))
    return pa.concat_tables(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "x_text", PIECE):
            for piece in pieces(part, "y_text", PIECE):
                x, y = Sets(piece.column("x_text")), Sets(piece.column("y_text"))
                ok = [bool(jaccard_links(len(np.intersect1d(x.set(i), y.set(i), assume_unique=True)), int(x.sizes[i]), int(y.sizes[i]))) for i in range(x.n)]
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column("x").filter(mask), piece.column("y").filter(mask)], ["a", "b"])


def _links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (x, y) whose texts link, as (a, b)."""
    used = scratch(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "njused")
    texts = rows.join(used, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("x_text")), "x").join(texts.select(F.col("id").alias("y"), F.col("text").alias("y_text")), "y")
    out = scratch(both.mapInArrow(_verify, "a long, b long").distinct(), "njlinks")
    drop(used)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, a, set) of (rep, text)."""
    for batch in batches:
        for part in pieces(batch, "text"):
            s = Sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(s.first, len(s.values)).astype(np.int32)), pa.array(s.values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(s.sizes), pa.array(s.ids[0].view(np.int64)), lists], ["rep", "n", "a", "set"])


def least_difference(x: bytes, y: bytes) -> int:
    """In how many elements sets differ at least, by their histograms."""
    a, b = (np.frombuffer(h, np.uint8).astype(np.int64) for h in (x, y))
    if len(a) != len(b):
        if (a == 255).any() or (b == 255).any():  # a stopped count can't be held against a folded one
            return 0
        a, b = a.reshape(-1, HIST).sum(0), b.reshape(-1, HIST).sum(0)
    return int(np.abs(a - b).sum())


def _can_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m = b.column("xn").to_numpy(), b.column("yn").to_numpy()
        ok = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        at = np.flatnonzero(ok)
        differ = [least_difference(x.as_py(), y.as_py()) for x, y in zip(b.column("xh").take(pa.array(at)), b.column("yh").take(pa.array(at)))]
        ok[at] = np.array(differ, np.int64) <= may_differ(n, m)[at]
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], ["x", "y"])


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of representatives that sizes and histograms do not refute."""
    facts = sets.select("rep", "n", "hist")
    both = pairs.join(facts.toDF("x", "xn", "xh"), "x").join(facts.toDF("y", "yn", "yh"), "y").where("4 * least(xn, yn) >= 3 * greatest(xn, yn)")
    return both.mapInArrow(_can_link, "x long, y long").distinct()


def _by_rep(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of 40-bit set ids (p, q) as distinct pairs of representatives (x < y)."""
    named = pairs.join(reps.select(F.col("id40").alias("p"), F.col("rep").alias("px")), "p").join(reps.select(F.col("id40").alias("q"), F.col("rep").alias("qx")), "q")
    return named.select(F.least("px", "qx").alias("x"), F.greatest("px", "qx").alias("y")).where("x < y").distinct()


def _spread(groups: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, rep, own, component) of groups whose sets lie in two classes or more."""
    members = groups.select("token", F.posexplode("ids").alias("pos", "id40"), "n_own").select("token", "id40", (F.col("pos") < F.col("n_own")).alias("own"))
    members = members.join(reps, "id40").select("token", "rep", "own")
    members = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = members.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    return members.join(split, "token", "left_semi")


def _short_sets(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep) of the sets whose hot tokens are worth more points than they can spare, by either scheme."""
    each = hot.select("token", F.posexplode("ids").alias("pos", "id40"), "n_own").select("token", "id40", (F.col("pos") < F.col("n_own")).alias("own")).distinct()
    lost = each.groupBy("id40").agg(F.count_if("own").alias("in_own"), F.count_if(~F.col("own")).alias("in_low"))
    return sets.select(_id40(), "rep", "own_spare", "low_spare").join(lost, "id40").where("in_own > own_spare or in_low > low_spare").select("rep").distinct()


def _front(short: DataFrame, rows: DataFrame) -> DataFrame:
    """The front shingles of the short sets."""
    texts = rows.join(short, rows["id"] == short["rep"]).select("rep", "text")
    sets = scratch(texts.mapInArrow(_shingles, "rep long, n long, a long, set array<long>").dropDuplicates(["rep", "a"]), "njshort")
    return prefixes.front(sets.select("rep", "n", "a", F.explode("set").alias("s")), ["rep", "a"], *LINKED, "njfront")


def _cross(members: DataFrame) -> DataFrame:
    """Pairs of a token's members in different classes, one of them at least of the token's own band."""
    left = members.select("token", F.col("rep").alias("x"), F.col("own").alias("xo"), F.col("component").alias("xc"))
    right = members.select("token", F.col("rep").alias("y"), F.col("own").alias("yo"), F.col("component").alias("yc"))
    return left.join(right, "token").where("x < y and xc <> yc and (xo or yo)").select("x", "y").distinct()


def _id40() -> Column:
    return F.greatest(F.expr("shiftrightunsigned(a, 24)"), F.lit(MARKER + 1)).alias("id40")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least id that links reach, itself included)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sizes = scratch(rows.mapInArrow(_measure, "id long, n long, a long, b long, own_spare int, low_spare int, hist binary"), "njsizes")
    filled = sizes.where("n > 0 and id is not null")
    sets = scratch(filled.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.min("own_spare").alias("own_spare"), F.min("low_spare").alias("low_spare"), F.first("hist").alias("hist")), "njsets")
    reps = sets.select(_id40(), "rep")
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    groups = scratch(rows.where("id is not null").mapInArrow(_emit(n_buckets), ENTRIES).groupBy("bucket").applyInArrow(_reduce, GROUPS), "njgroups")
    cold = groups.where("not hot")
    short = scratch(_short_sets(groups.where("hot"), sets), "njfew")
    front = _front(short, rows)
    star = _by_rep(cold.select(F.col("leader").alias("p"), F.explode("ids").alias("q")).where("p <> q").distinct(), reps)
    tested = scratch(_plausible(star.unionByName(prefixes.led(front, None, 0, *LINKED)).distinct(), sets), "njpairs")
    links = _links(tested, rows)
    found = connected_components(links, "njcc")

    def further(pairs: DataFrame) -> bool:
        """Test pairs of different classes that were not tested; whether any links."""
        nonlocal tested, links, found
        fresh = scratch(_plausible(pairs.join(tested, ["x", "y"], "left_anti"), sets), "njpairs")
        if fresh.isEmpty():
            return False
        more = _links(fresh, rows)
        tested = tested.unionByName(fresh)
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        found = connected_components(links, "njcc")
        return True

    for r in range(1, ROUNDS):
        if not further(prefixes.led(front, found, r, *LINKED)):
            break
    # what is left: pairs in different classes, of small groups and of short sets
    further(_cross(scratch(_spread(cold.where("size > 2"), reps, found), "njsmall")).unionByName(prefixes.crossed(front, found, *LINKED, "njmixed")).distinct())
    drop(groups, front, short)
    rep_of = sets.select("n", "a", "b", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    # an id that stands on several rows joins their classes
    out = sizes.join(rep_of, ["n", "a", "b"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its class; null ids and texts without words stay."""
    found = classes(docs, id_column, text_column).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("nj__gone")).distinct()
    return docs.join(found, docs[id_column] == F.col("nj__gone"), "left_anti")


def op9_ngram_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
