"""Benchmark decontamination by template canonicalisation.

Words lose case and outer signs; numbers, names and units become typed slots (<num>, <name>, <unit>). Windows of WINDOW
template words of every document meet the benchmark's windows by hash. A hit is a contamination if the slots are
consistent: either the filled words are the same (a plain copy), or the question was re-parameterised, that is, each
value of a slot in the item always turns into the same value of the same type in the document, and different values into
different ones. Windows with less than MIN_FIXED words that are no slots say too little for that and are left out. A
second hash takes the words as they are but for case and outer signs: equal words are a copy, names in any case.

Hashes go first: the benchmark's mark a bit table of fixed size, which every task holds, and a document's windows that
both bits let pass are noted beside it with their words, each distinct one once a task. Those windows, few, are then
joined with the benchmark's by hash, slots and words are checked on what meets, and documents learn of it by a row number
of their own. A benchmark too large for the bit table costs work, not results; the driver holds that table alone.

Edge cases: null, empty and short texts have no window and are clean; an item with fewer than WINDOW words is one window
of its own length if it has MIN_FIXED fixed words (or SHORTEST words, for plain copies), and matches documents' windows of
that length; shorter items say too little and are never looked for; ties do not arise; very long texts are windowed whole; repeated rows are
judged alike; an empty benchmark leaves all clean; in filters all columns stay as they are, working columns are prefixed
dec__. Texts of any length are windowed whole, in slices of rows of a few MB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from .textnum import flat, hash_spans, mix, pieces, word_spans

WINDOW = 13
MIN_FIXED = 6
#: Words that an item needs for its plain copies to be looked for, whatever its words are.
SHORTEST = 8
#: Bits of the table that marks hashes of the benchmark's windows, two for each: 8 MB.
MARKS = 1 << 26
#: Distinct windows whose words a task remembers to have noted.
NOTED = 200_000

#: Words for units and numbers, as they stand in questions.
UNITS = frozenset("mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years inch inches foot feet ft yard yards mile miles pound pounds lb lbs ounce ounces oz gallon gallons liter liters litre litres meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons dollar dollars euro euros cent cents usd eur gbp percent % degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts amp amps hz khz mhz ghz kb mb gb tb".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen twice".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")
SIGNS = "\"'`.,;:!?()[]{}<>*_~“”‘’«»…|#&"

NUM, NAMED, UNIT = "<num>", "<name>", "<unit>"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def canonical(words: list[str]) -> tuple[list[str], list[tuple[str, str] | None]]:
    """Template words, and of slots their type and value.

    A capitalised word is a name if the word before it ends no sentence: the first word of a text or sentence is a word.
    """
    out, slots, start = [], [], True
    for w in words:
        core = w.strip(SIGNS)
        low = core.lower()
        if NUMBER.fullmatch(core) or low in NUMBERS:
            kind = NUM
        elif low in UNITS and out and out[-1] == NUM:
            kind = UNIT
        elif not start and NAME.fullmatch(core):
            kind = NAMED
        else:
            kind = ""
        out.append(kind or low)
        slots.append((kind, low) if kind else None)
        start = w[-1:] in ".!?:" or not core
    return out, slots


def consistent(a: list, b: list) -> bool:
    """Whether slots b follow from slots a by one renaming of values within types."""
    there, back = {}, {}
    for x, y in zip(a, b):
        if (x is None) != (y is None):
            return False
        if x is not None and (x[0] != y[0] or there.setdefault(x, y) != y or back.setdefault(y, x) != x):
            return False
    return True


# Vectorised canonicalisation: a word's template word depends on its bytes, on whether a sentence begins, and on whether
# a number stands before it. Distinct words are looked at once each, in Python; their sequences in numpy.


def _facts(word: str) -> tuple[int, int, int, int]:
    """(0 none, 1 number, 2 perhaps a unit, 3 perhaps a name), hash of the word as a word, ends a sentence."""
    core = word.strip(SIGNS)
    low = core.lower()
    kind = 1 if NUMBER.fullmatch(core) or low in NUMBERS else 2 if low in UNITS else 3 if NAME.fullmatch(core) else 0
    return kind, int(word[-1:] in ".!?:" or not core), low


def template_hashes(data: np.ndarray, bounds: np.ndarray, known: dict) -> tuple[np.ndarray, ...]:
    """Hashes of each word's template word and plain word, whether it is a slot, words a text, the words' starts and ends."""
    starts, ends, counts = word_spans(data, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), counts, starts, ends
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    packed = np.ascontiguousarray(data[~_is_space(data)])
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    if len(known) > 1_000_000:
        known.clear()
    fresh = [n for n in names if n not in known]
    if fresh:
        facts = [_facts(n) for n in fresh]
        raw, cut = flat(pa.array([f[2] for f in facts], pa.large_string()))
        # hash_spans needs spans; empty cores hash alike
        hashes = hash_spans(raw, cut[:-1], cut[1:])
        known.update((n, (f[0], f[1], int(h))) for n, f, h in zip(fresh, facts, hashes))
    rows = [known[n] for n in names]
    index = coded.indices.to_numpy()
    kind = np.fromiter((r[0] for r in rows), np.int8, len(rows))[index]
    closes = np.fromiter((r[1] for r in rows), np.int8, len(rows))[index].astype(bool)
    word = np.fromiter((r[2] for r in rows), np.uint64, len(rows))[index]
    first = np.zeros(len(starts) + 1, bool)
    first[np.cumsum(counts) - counts] = True
    first = first[:-1]
    begins = first | np.append(True, closes[:-1])
    number = kind == 1
    unit = (kind == 2) & ~first & np.append(False, number[:-1])
    name = (kind == 3) & ~begins
    plain = word.copy()
    for mark, slot in ((1, number), (2, unit), (3, name)):
        word[slot] = mix(np.full(1, mark, np.uint64))[0]
    return word, plain, number | unit | name, counts, starts, ends


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def _windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words where a window of width words begins and stays in its text, and the windows' hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)
    total = np.zeros(n - width + 1, np.uint64)
    for k, f in enumerate(mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)):
        total += words[k : n - width + 1 + k] * f
    at = np.flatnonzero(left[: n - width + 1] >= width)
    return at, mix(total[at] + np.uint64(width))


def benchmark_windows(benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """(width, plain, hash, words): the distinct windows of all items with their words, by template and by plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            widths, plains, hashes, words = [], [], [], []
            for text in batch.column("text"):
                ws = words_of(text.as_py() or "")
                width = min(WINDOW, len(ws))
                if not width:
                    continue
                word, plain, slot, counts, _, _ = template_hashes(*flat(pa.array([" ".join(ws)])), known)
                for as_is, hashed in ((False, word), (True, plain)):
                    at, h = _windows(hashed, counts, width)
                    for i, x in zip(at.tolist(), h.tolist()):
                        if width - int(slot[i : i + width].sum()) >= MIN_FIXED or (as_is and width >= min(WINDOW, SHORTEST)):
                            widths.append(width)
                            plains.append(as_is)
                            hashes.append(np.uint64(x).view(np.int64))
                            # the word before shows whether the first one begins a sentence
                            words.append(ws[i - 1 : i + width] if i else ["", *ws[:width]])
            yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array(plains, pa.bool_()), pa.array(hashes, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["width", "plain", "hash", "words"])

    rows = benchmark.select(F.col(text_column).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "width int, plain boolean, hash long, words array<string>").distinct()


def slots_of(words: list[str]) -> list:
    """Slots of a window whose first entry is the word before it."""
    return canonical(words)[1][1:] if words[0] else canonical(words[1:])[1]


def facts_of(words: list[str], plain: bool):
    """What windows of one hash are compared by: words but for case and signs, or slots."""
    return [w.strip(SIGNS).lower() for w in words[1:]] if plain else slots_of(words)


def agree(plain: bool, item: list, found: list) -> bool:
    return item == found if plain else consistent(item, found)


def _bits(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of 64-bit hashes in a table of n bits, a power of two."""
    return h % np.uint64(n), (h >> np.uint64(32)) % np.uint64(n)


def _marks(table: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's hashes, as 64-bit words; MARKS / 64 rows at most reach the driver."""
    spots = F.array(F.pmod("hash", F.lit(MARKS)), F.pmod(F.call_function("shiftrightunsigned", F.col("hash"), F.lit(32)), F.lit(MARKS)))
    words = table.select(F.explode(spots).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("i"))
    out = np.zeros(MARKS // 64, np.uint64)
    for r in words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("w")).toLocalIterator():
        out[r["i"]] = np.int64(r["w"]).view(np.uint64)
    return out


FOUND = "array<struct<case:bigint,width:int,plain:boolean,hash:bigint,words:array<string>>>"


def _noted(marks: np.ndarray, kinds: list[tuple[int, bool]], column: pa.Array, known: dict, seen: set) -> list[list[dict] | None]:
    """Of each text the windows that the table lets pass, each once, with words where this task has not noted them."""
    data, bounds = flat(column)
    word, plain_word, _, counts, starts, ends = template_hashes(data, bounds, known)
    text, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    out: list[dict[int, dict] | None] = [None] * len(column)
    for width, plain in kinds:
        at, h = _windows(plain_word if plain else word, counts, width)
        on = np.ones(len(h), bool)
        for p in _bits(h, 64 * len(marks)):
            on &= (marks[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        for i in np.flatnonzero(on):
            a = int(at[i])
            lead = a > first[text[a]]  # the word before shows whether the first one begins a sentence
            span = [data[starts[j] : ends[j]].tobytes().decode() for j in range(a - lead, a + width)]
            words = span if lead else ["", *span]
            key = int(h[i].view(np.int64))
            case = int.from_bytes(hashlib.blake2b("\0".join([str(width), str(plain), str(key), *words]).encode(), digest_size=8).digest(), "big", signed=True)
            if out[text[a]] is None:
                out[text[a]] = {}
            if case not in out[text[a]]:
                out[text[a]][case] = {"case": case, "width": width, "plain": plain, "hash": key, "words": None if case in seen else words}
                if len(seen) >= NOTED:
                    seen.clear()
                seen.add(case)
    return [None if x is None else list(x.values()) for x in out]


def mark(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", benchmark_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs, or its columns carry, with dec__hit: whether the text holds a benchmark window, re-parameterised ones included."""
    spark, names = docs.sparkSession, carry or docs.columns
    table = scratch(benchmark_windows(benchmark, benchmark_text), "benchwindows")
    kinds = [(r.width, r.plain) for r in table.select("width", "plain").distinct().collect()]  # at most 2 * WINDOW of them
    shared = spark.sparkContext.broadcast(_marks(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, n = {}, set(), TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("case", pa.int64()), ("width", pa.int32()), ("plain", pa.bool_()), ("hash", pa.int64()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            for part in pieces(batch, text_column):
                found = _noted(shared.value, kinds, part.column(text_column), known, seen)
                rows = pa.array(range(n, n + part.num_rows), pa.int64())
                n += part.num_rows
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], rows, pa.array(found, kind)], [*names, "dec__row", "dec__found"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    needed = docs.select(*names, *([] if text_column in names else [text_column]))
    noted = scratch(needed.mapInArrow(run, f"{fields}, dec__row long, dec__found {FOUND}"), "decdocs")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [agree(p, facts_of(a, p), facts_of(b, p)) for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("plain", "words", "found")))]
            yield pa.RecordBatch.from_arrays([batch.column("case").filter(pa.array(ok, pa.bool_()))], ["case"])

    found = noted.where("dec__found is not null").select("dec__row", F.explode("dec__found").alias("f")).select("dec__row", "f.*")
    cases = found.where("words is not null").select("case", "width", "plain", "hash", F.col("words").alias("found")).dropDuplicates(["case"])
    met = cases.join(table, ["width", "plain", "hash"]).select("case", "plain", "words", "found")
    right = scratch(met.mapInArrow(check, "case long").distinct(), "deccases")
    hits = scratch(found.join(right, "case", "left_semi").select("dec__row", F.lit(True).alias("dec__hit")).distinct(), "dechits")
    return noted.join(hits, "dec__row", "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("dec__hit", F.lit(False)).alias("dec__hit"))


def remove(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", benchmark_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark window."""
    return mark(docs, benchmark, text_column, benchmark_text).where("not dec__hit").drop("dec__hit")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), carry=["doc_id"])
    return marked.select("doc_id", F.col("dec__hit").alias("contaminated"))
