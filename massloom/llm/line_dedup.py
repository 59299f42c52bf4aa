"""Fuzzy line deduplication by MinHash, exact verification and distributed union-find: one line of each class stays.

Lines are compared by their character shingles: all runs of SHINGLE characters, of which a shorter line is one. Signatures
hash every shingle of every line and keep the least hash of each of BINS ranges (one-permutation MinHash; an empty range
borrows the next one's). Lines are written four bytes a character for that, so that a shingle is found by its place, and
shingles are rows of generated code that a grouped minimum folds in the task that made them. Hashes too great to be a
range's least (chance exp(-SPARE)) are left out before the fold.

BANDS bands of ROWS hashes meet by equal hash. In a band's bucket each line is compared with one leader, the bucket's least
or greatest line by its hash, if both agree in AGREE of the BINS hashes at least (at similarity 0.8 a pair agrees in fewer
with chance 0.0015). Links make classes, and then all pairs of a bucket that lie in different classes are compared as well:
outright, with the same demand, in buckets of up to SMALL lines. Lines of larger buckets meet by an exact prefix filter over
their rarest shingles, leaders of families first, then pairs of different classes. A pair is verified by the exact Jaccard similarity of all shingles, at
least THRESHOLD; verified links make classes, of which the occurrence with the least (doc_id, line number) stays. Exact
copies are one line from the start and need no link. A pair of similarity 0.8 meets with chance 0.97, of 0.9 with 0.998.

All is DataFrame functions. Only hashes are shuffled; texts of lines that share a bucket alone are fetched again, behind a
Bloom filter of fixed size, which spares work where it is not full and changes no result.

Edge cases: lines without a word stay and are not compared; null and empty texts have no line; documents with a null id
lose nothing and take no part; rows that repeat an id are treated alike; all other columns pass through, working
columns are prefixed ld__; an empty table gives an empty result; very long texts and lines are read whole. A class's lines are known by 64-bit hashes of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefixes
from .common import WORD_SPACE, connected_components, drop, let, scratch

SHINGLE = 10
#: Lines of a bucket up to which all its pairs in different classes are compared outright.
SMALL = 16
#: Rounds of leaders in larger buckets before their lines of different classes are compared; one without links ends them.
ROUNDS = 3
SIMILAR = (4, 5)
THRESHOLD = SIMILAR[0] / SIMILAR[1]
BINS, BANDS, ROWS, AGREE = 16, 5, 3, 8
#: Hashes of a line that each range has, on average, below the limit beyond which none is kept.
SPARE = 10
#: The first, second and third characters of a sample's shingles, as classes of regular expressions: about half of letters,
#: weighed by their frequency or not, and of digits each; about a sixth of shingles of prose, addresses and numbers alike
#: begin so, and no kind of text weighs more than another. Other scripts' characters are in all three.
_WIDE = "\\x{250}-\\x{10FFFF}"
FIRST, SECOND, THIRD = f"acegikmoqsuwyACEGIKMOQSUWY02468{_WIDE}", f"bdfhjlnprtvxzBDFHJLNPRTVXZ13579{_WIDE}", f" a-mA-M0-4{_WIDE}"
FILTER_BITS = 1 << 23
LINE_LIMIT = 1 << 31
LOW = (1 << 32) - 1
PARTS = [f"g{i}" for i in range(BINS // 2)]


def _wide(line: Column) -> Column:
    """A line's characters, four bytes each."""
    return F.encode(line, "UTF-32")


def _last(wide: Column) -> Column:
    """The place of a line's last shingle, from 0."""
    return F.greatest(F.lit(0), F.call_function("shiftright", F.length(wide), F.lit(2)) - SHINGLE)


def _shingle(wide: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(wide, place * 4 + 1, F.lit(4 * SHINGLE)))


def shingles_in_order(line: Column) -> Column:
    """Hashes of the shingles of a line, from every character on, repeats included; a shorter line is one shingle."""
    return let(_wide(line), lambda w: F.transform(F.sequence(F.lit(1), _last(w) * 4 + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SHINGLE)))))


def shingles(line: Column) -> Column:
    """Hashes of the distinct shingles of a line."""
    return F.array_distinct(shingles_in_order(line))


def sample(line: Column) -> Column:
    """The shingles of a line, in order, repeats included, that are its first or begin with characters of FIRST, SECOND and THIRD. Signatures hash all."""
    # whether a place is one depends on three characters from it on, so an edit changes the sample only near it
    return F.regexp_extract_all(line, F.lit(f"(?s)(?:(?=[{FIRST}][{SECOND}][{THIRD}])|^)(?=(.{{{SHINGLE}}}|^.{{1,{SHINGLE - 1}}}\\z))."), F.lit(1))


def _limit(last: Column) -> Column:
    """What a kept hash's place in its range lies below, of 2^32."""
    return F.lit(SPARE * BINS << 32) / F.greatest(last, F.lit(1))


def _range(x: Column) -> Column:
    """The range that a hash is in, from -BINS / 2."""
    return F.call_function("shiftright", x, F.lit(64 - (BINS - 1).bit_length()))


def _packed(least: list[Column]) -> list[Column]:
    """The least hashes of all ranges, null if there is none, as BINS / 2 longs."""
    full = [F.coalesce(*least[k:], *least[:k]) for k in range(BINS)]
    return [full[k].bitwiseOR(F.call_function("shiftleft", full[k + 1], F.lit(32))) for k in range(0, BINS, 2)]


def signature(line: Column) -> Column:
    """A line's least hashes of all ranges, 32 bits of each, two in a long: an array of BINS / 2 longs."""
    hashes = lambda w: F.filter(F.transform(F.sequence(F.lit(0), _last(w)), lambda i: _shingle(w, i)), lambda x: x.bitwiseAND(F.lit(LOW)) < _limit(_last(w)))
    least = lambda s: [F.array_min(F.transform(F.filter(s, lambda x: _range(x) == k), lambda x: x.bitwiseAND(F.lit(LOW)))) for k in map(F.lit, range(-BINS // 2, BINS // 2))]
    return let(let(let(_wide(line), hashes), lambda s: F.array(*least(s))), lambda m: F.array(*_packed([F.get(m, k) for k in range(BINS)])))


def signatures(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(h, h2, place, n, PARTS) of the distinct lines of rows: two hashes, least place, number of occurrences and signature().

    lines: hashed(rows), where it stands in a table already."""
    wide = rows.select(*line_hashes(), _wide(F.col("ld__line")).alias("w")).withColumn("last", _last(F.col("w"))).withColumn("limit", F.ceil(_limit(F.col("last"))))
    each = wide.select("h", "h2", "w", "limit", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    # the task's number keeps the filter below from going ahead of the hash, which would then be found twice
    each = each.select("h", "h2", "i", "limit", _shingle(F.col("w"), F.col("i")).alias("x"), F.spark_partition_id().alias("task"))
    each = each.select("h", "h2", "i", "limit", "task", _range(F.col("x")).alias("r"), F.col("x").bitwiseAND(F.lit(LOW)).alias("v"))
    # a line's first shingle keeps it, whatever its hash
    low = [F.min(F.when((F.col("r") == k) & (F.col("v") < F.col("limit")), F.col("v"))).alias(f"m{k + BINS // 2}") for k in range(-BINS // 2, BINS // 2)]
    found = each.where("task >= 0 and (i = 0 or v < limit)").groupBy("h", "h2").agg(*low)
    # places are folded apart, once a line: a decimal in the fold above would be read and written for each shingle
    places = (hashed(rows) if lines is None else lines).groupBy("h", "h2").agg(F.min(_place(F.col("ld__no"), F.col("ld__id"))).alias("place"), F.count("*").alias("n"))
    return found.join(places.hint("shuffle_hash"), ["h", "h2"]).select("h", "h2", "place", "n", *[p.alias(g) for g, p in zip(PARTS, _packed([F.col(f"m{k}") for k in range(BINS)]))])


def bands(parts: list[Column]) -> Column:
    """Band hashes of a signature's longs: an array of BANDS longs."""
    bins = [half for p in parts for half in (p.bitwiseAND(F.lit(LOW)), F.call_function("shiftrightunsigned", p, F.lit(32)))]
    return F.array(*[F.xxhash64(F.lit(b), *bins[ROWS * b : ROWS * (b + 1)]) for b in range(BANDS)])


def agreement(a: list[Column], b: list[Column]) -> Column:
    """In how many ranges two signatures have the same hash."""
    differ = [x.bitwiseXOR(y) for x, y in zip(a, b)]
    same = [half == 0 for d in differ for half in (d.bitwiseAND(F.lit(LOW)), F.call_function("shiftrightunsigned", d, F.lit(32)))]
    return sum((x.cast("int") for x in same[1:]), same[0].cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, repeats not counted."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def lines_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(ld__id, ld__no, ld__line) of the lines with a word."""
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("ld__id"), F.posexplode(F.split(text_column, "\n")).alias("ld__no", "ld__line"))
    return rows.where(F.ltrim("ld__line", F.lit(WORD_SPACE)) != "")


def line_hashes() -> list[Column]:
    return [F.xxhash64("ld__line").alias("h"), F.xxhash64(F.lit(7), "ld__line").alias("h2")]


def hashed(rows: DataFrame) -> DataFrame:
    """(h, h2, ld__id, ld__no) of lines_of()."""
    return rows.select(*line_hashes(), "ld__id", "ld__no")


def _place(no: Column, of: Column) -> Column:
    """(id, line number) as one ordered number, so that a grouped minimum stays a plain hash aggregate."""
    return of.cast("decimal(20,0)") * F.lit(LINE_LIMIT).cast("decimal(11,0)") + no.cast("decimal(10,0)")


def fates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(ld__id, ld__gone): the numbers of the lines that go, of each document that loses any."""
    rows = lines_of(docs, id_column, text_column)
    lines = scratch(hashed(rows), "ldlines")
    unique = scratch(signatures(rows, lines), "ldunique")
    # dealt by key once, for the leaders and for their buckets' lines
    keys = unique.select("h", F.explode(bands([F.col(g) for g in PARTS])).alias("key")).repartition("key")
    leads = keys.groupBy("key").agg(F.min("h").alias("l0"), F.max("h").alias("l1")).where("l0 <> l1").select("key", F.when(F.col("key") % 2 == 0, F.col("l0")).otherwise(F.col("l1")).alias("lead"))
    members = scratch(keys.join(leads.hint("shuffle_hash"), "key").select("key", "h", "lead"), "ldmembers")
    near = members.select("h").distinct()
    met = _texts(_marked(unique, near).join(near, "h"), rows)
    pairs = scratch(members.where("h <> lead").select(F.least("h", "lead").alias("x"), F.greatest("h", "lead").alias("y")).distinct(), "ldpairs")
    links = _verified(pairs, met)
    found = connected_components(links, "ldcc")
    rest = _rest(members, found, pairs, met)
    if not rest.isEmpty():
        found = connected_components(found.toDF("a", "b").unionByName(rest), "ldcc")
    # the least place of each class, and what is not at it
    named = _marked(unique.select("h", "h2", "place", "n"), found.select(F.col("node").alias("h")), F.col("n") > 1).join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("component", "h"))
    fuzzy = named.where("component is not null")
    best = fuzzy.groupBy("class").agg(F.min("place").alias("best"))
    lost = named.join(best, "class", "left").select("h", "h2", F.coalesce("best", "place").alias("best"), "n", "place").where("n > 1 or best <> place").select("h", "h2", "best")
    lost = scratch(lost, "ldlost")
    gone = _marked(lines, lost).join(lost, ["h", "h2"]).where(_place(F.col("ld__no"), F.col("ld__id")) != F.col("best"))
    out = scratch(gone.groupBy("ld__id").agg(F.array_sort(F.collect_set("ld__no")).alias("ld__gone")), "ldgone")
    drop(lines, unique, members, met, pairs, links, lost)
    return out


def _rest(members: DataFrame, found: DataFrame, tested: DataFrame, met: DataFrame) -> DataFrame:
    """The links (a, b) that all pairs of a bucket's lines in different classes give after the leaders' links."""
    classed = members.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("component", "h"))
    split = classed.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("n > 2 and c0 <> c1").select("key", "n")
    classed = scratch(classed.join(split, "key").select("key", "h", "class", "n"), "ldsplit")
    side = lambda h: classed.where(F.col("n") <= SMALL).select("key", F.col("h").alias(h), F.col("class").alias(f"{h}c"))
    small = side("x").join(side("y"), "key").where("x < y and xc <> yc").select("x", "y").distinct()
    small = scratch(small.join(tested, ["x", "y"], "left_anti"), "ldrest")
    out = _verified(small, met)
    large = classed.where(F.col("n") > SMALL).select("h", "class").distinct()
    if not large.isEmpty():
        out = out.unionByName(_large(large, tested.unionByName(small), met))
    drop(classed, small)
    return out


def _large(lines: DataFrame, tested: DataFrame, met: DataFrame) -> DataFrame:
    """The links (a, b) of lines of large buckets (h, class): by leaders of their rarest shingles, so that families of
    near copies become one class, and then by all pairs of lines still in different classes that can link."""
    # these lines meet many others each, so that sets are found once a line; leaders' lines meet few, and texts travel lighter
    sets = scratch(met.join(lines.select("h"), "h", "left_semi").select("h", shingles(F.col("line")).alias("set")), "ldsets")
    fronts = prefixes.front(sets.select(F.col("h").alias("rep"), F.size("set").alias("n"), F.explode("set").alias("s")), ["rep"], *SIMILAR, "ldfront")
    found = scratch(lines.select(F.col("h").alias("node"), F.col("class").alias("component")), "ldclasses")
    out = None
    r, leading = 0, True
    while True:
        pairs = prefixes.led(fronts, found, r, *SIMILAR) if leading else prefixes.crossed(fronts, found, *SIMILAR, "ldmixed")
        pairs = scratch(pairs.join(tested, ["x", "y"], "left_anti"), "ldpairs")
        tested = tested.unionByName(pairs)
        links = _verified(pairs, sets, "set", lambda c: c)
        out = links if out is None else out.unionByName(links)
        if not leading:
            break
        r, none = r + 1, links.isEmpty()
        leading = r < ROUNDS and not none
        if not none:
            edges = links.join(found.toDF("a", "ac"), "a").join(found.toDF("b", "bc"), "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))
            joined = connected_components(edges, "ldcc").toDF("component", "to")
            found = scratch(found.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "ldclasses")
    drop(fronts, sets)
    return out


def _marked(lines: DataFrame, used: DataFrame, also: Column | None = None) -> DataFrame:
    """The lines with hashes (h) that those used may have, or for which also holds, by a Bloom filter that is a table of FILTER_BITS / 64 rows at most."""
    mark = lambda h: F.pmod(h, F.lit(FILTER_BITS)).cast("int")
    word = lambda p: F.call_function("shiftright", p, F.lit(6)).alias("ld__i")
    words = used.select(mark(F.col("h")).alias("p")).groupBy(word(F.col("p"))).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 64)).alias("ld__w"))
    held = F.call_function("shiftrightunsigned", F.col("ld__w"), mark(F.col("h")) % 64).bitwiseAND(F.lit(1)) == 1
    met = lines.withColumn("ld__i", word(mark(F.col("h")))).join(F.broadcast(words), "ld__i", "inner" if also is None else "left")
    return met.where(held if also is None else also | held).drop("ld__i", "ld__w")


def _texts(used: DataFrame, rows: DataFrame) -> DataFrame:
    """(h, PARTS, line) of the lines used (h, place, PARTS)."""
    used = scratch(used.select("h", "place", *PARTS).dropDuplicates(["h"]), "ldused")
    near = _marked(rows.select("ld__id", "ld__no", "ld__line", F.xxhash64("ld__line").alias("h")), used)
    near = near.select(_place(F.col("ld__no"), F.col("ld__id")).alias("place"), F.col("ld__line").alias("line"))
    out = scratch(near.join(used.hint("shuffle_hash"), "place").select("h", *PARTS, "line").dropDuplicates(["h"]), "ldtexts")
    drop(used)
    return out


def _verified(pairs: DataFrame, held: DataFrame, column: str = "line", as_set=shingles_in_order) -> DataFrame:
    """The pairs (x, y) of line hashes whose lines have Jaccard similarity THRESHOLD or more, as (a, b); as_set makes sets of
    held's column. Of lines with signatures, those that agree in AGREE ranges at least."""
    parts = [g for g in PARTS if g in held.columns]
    # hash joins, so that no texts are sorted
    side = lambda k: held.select(F.col("h").alias(k), *[F.col(g).alias(f"{k}{g}") for g in parts], F.col(column).alias(f"{k}v")).hint("shuffle_hash")
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    if parts:
        both = both.where(agreement([F.col(f"x{g}") for g in parts], [F.col(f"y{g}") for g in parts]) >= AGREE)
    both = both.select("x", "y", as_set(F.col("xv")).alias("xs"), as_set(F.col("yv")).alias("ys"))
    # written with their similarity and read back above it: a filter here would find the sets once for each mention
    tested = scratch(both.select(F.col("x").alias("a"), F.col("y").alias("b"), jaccard(F.col("xs"), F.col("ys")).alias("same")), "ldlinks")
    out = tested.where(F.col("same") >= THRESHOLD).select("a", "b")
    out._scratch_path = tested._scratch_path
    return out


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the text of the lines that stay, all columns in place."""
    gone = fates(docs, id_column, text_column)
    rows = docs.join(gone, docs[id_column] == gone["ld__id"], "left")
    stay = F.filter(F.split(text_column, "\n"), lambda x, i: ~F.array_contains("ld__gone", i))
    text = F.when(F.col("ld__gone").isNull(), F.col(text_column)).otherwise(F.array_join(stay, "\n"))
    return rows.select(*[text.alias(c) if c == text_column else docs[c] for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = fates(docs)
    counts = docs.select("doc_id", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = counts.join(gone, counts["doc_id"] == gone["ld__id"], "left")
    return out.select("doc_id", "n_lines", F.when(F.col("ld__gone").isNull(), 0).otherwise(F.size("ld__gone")).cast("long").alias("n_removed"), F.coalesce(F.array_join("ld__gone", ","), F.lit("")).alias("removed"))
