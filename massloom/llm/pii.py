"""PII surrogates: detected entities get keyed, type-consistent replacements of the same format.

Emails, phone numbers, card numbers, IPv4 addresses and person names are found by patterns: names after a title, with a
known given name, after words that introduce one (my name is, signed, contact) or before an email address in
brackets. A surrogate comes from a keyed permutation (a Feistel network over the exact domain of the entity's format), so
one entity has one surrogate everywhere (coreference) and two entities of a format have two (distinctness), with no table
to share. Digits stay digits, letters keep case and script, Luhn-valid cards stay valid and others invalid, country codes
stay, and so do the domains reserved for examples; other domains change like their mailboxes, but for the last label.
Given names keep gender and script, and parts of a name map one by one. Every other mention of a found part in the same
document, as a word of its own (anywhere in scripts without capitals), is replaced as well, so that a later surname still
refers and doesn't give the name away. Letters beyond the listed classes change among those of their Unicode row and case.

Collision checks make that hold over the whole corpus: the distinct entities are a distributed table; a surrogate that
equals an original entity, or another entity's surrogate, of any kind that is written alike, is drawn again until none
collides. A draw takes the next tweak of the permutation; every TRIES tweaks the domain grows by a character (given names
leave their list first), so that a corpus that uses a whole domain is served too; IPv4 addresses can't grow and may equal
an original from the second draw on, but never another's surrogate. Only entities that collide are drawn again. Whole
values are checked: a surrogate's domain alone may be that of another mailbox.

Edge cases: null and empty texts stay; repeated rows get the same surrogates; overlapping finds go to the earliest, then
longest; of entities that draw one surrogate the least kind and value keeps it; very long texts are scanned whole; an
empty table gives an empty result; all other columns pass through, working columns are prefixed pii__.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch

EMAIL = re.compile(r"[^\W_][\w.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A)
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", re.A)
CARD = re.compile(r"(?<![\w.-])(?:\d{4}[ -]){3}\d{1,7}(?!\w)|(?<![\w.-])\d{13,19}(?!\w)", re.A)
DIGITS = re.compile(r"\d[\d ().-]{5,}\d", re.A)

#: Given names by script and gender; a name maps to another of its list.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatrice Camille Carla Carmen Charlotte Clara Diana Elena Emma Eva Fiona Greta Hannah Helena Ines Irene Julia Karin Laura Lena Lucia Maria Marta Mary Nadia Nina Olivia Paula Petra Rosa Sarah Silvia Sofia Sonia Susan Teresa Ursula Vera".split(),
    ("latin", "m"): "Adam Albert Andreas Anton Bruno Carlos Charles Christian Daniel David Diego Emil Eric Felix Frank Georg Henri Hugo Ivan Jan John Jorge Karl Leo Louis Luis Marc Martin Michael Nils Oscar Pablo Paul Peter Pierre Robert Simon Stefan Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
_GENDER = {n: k for k, names in GIVEN.items() for n in names}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
#: Signs that stand within words: combining ones, and those of the Indic rows.
_INNER = "(?:[^\\W\\d_]|[\u0300-\u036f\u0900-\u0dff])"
_CAPITAL = rf"[^\W\d_a-zß-öø-ÿа-я]{_INNER}+"
NAME = re.compile(rf"\b(?:({'|'.join(TITLES)})\.? +({_CAPITAL})(?: ({_CAPITAL}))?|({'|'.join(_GENDER)}) ({_CAPITAL}))(?!\w)")
NAME_HINT = re.compile(rf"\b(?:{'|'.join(TITLES)})\b|\b(?:{'|'.join(_GENDER)}) ")
#: Words that introduce a name, and names that an address in brackets follows.
CUED = re.compile(rf"(?:\b(?:[Mm]y name is|[Nn]ame:|[Ss]igned,|[Ss]igned by|[Cc]ontact(?: person)?:|[Ss]incerely,|[Rr]egards,|[Aa]uthor:|[Aa]ttn:?)\s+({_CAPITAL})((?:[ -]{_CAPITAL}){{0,2}})|\b({_CAPITAL})((?: {_CAPITAL}){{1,2}})(?= ?[<(\[][^\s@<>()]+@))(?!\w)")
CUE_HINT = re.compile(r"(?i)name is|name:|signed|contact|sincerely|regards|author:|attn|[<(\[][^\s@<>()]+@")

CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, range(0x3B1, 0x3CA))))
_CLASS = {c: x for x in CLASSES for c in x}
#: Capitalised words that follow a cue and are no names.
STOP = set("A An And At Best Customer Dear Department For From Hello Here Hi I If In Info It Kind Many Me My No Office On Or Our Please Sales Service Sir Support Team Thank Thanks That The Their They This To Us We With Yes You Your Yours".split())
WORDS = re.compile(rf"{_INNER}+")
RESERVED = re.compile(r"(?:^|\.)(?:example\.(?:com|net|org)|example|test|invalid)$")

#: Draws from a domain before it grows.
TRIES = 3
#: Entities drawn again that are sent to every worker; more of them reach their documents by a join.
MAX_SENT = 200_000

Entity = tuple[str, int, int, str]  # kind, start, end, canonical value


@functools.lru_cache(maxsize=1 << 16)
def class_of(c: str) -> str | None:
    """The characters that one changes among: a listed class, or the other letters of its 128 code points, script and category."""
    if c in _CLASS or not c.isalpha():
        return _CLASS.get(c)
    row, kind = ord(c) & ~0x7F, unicodedata.category(c)
    return "".join(x for x in map(chr, range(row, row + 0x80)) if unicodedata.category(x) == kind and _script(x) == _script(c) and x not in _CLASS)


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to n - 1: a Feistel network over the next even power of two, walked until inside."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            h = hashlib.blake2b(f"{r}:{n}:{tweak}:{b}".encode(), key=key, digest_size=(half + 7) // 8 + 1).digest()
            a, b = b, a ^ (int.from_bytes(h, "big") & mask)
        x = (a << half) | b
        if x < n:
            return x


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """Characters change within their class (digits, letters of a case and script), others stay; a bijection by format."""
    x, n = 0, 1
    for c in text:
        of = class_of(c)
        if of:
            x, n = x * len(of) + of.index(c), n * len(of)
    shape = "".join(chr(0xE000 + CLASSES.index(of)) if of in CLASSES else of[0] if of else c for c, of in zip(text, map(class_of, text)))
    x, out = permute(x, n, key, f"{tweak}:{shape}"), []
    for c in reversed(text):
        of = class_of(c)
        if of:
            x, k = divmod(x, len(of))
            c = of[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _walk(value: str, step, ok) -> str:
    """Apply a bijection until the result is admissible; from an admissible value that is a bijection of these."""
    while True:
        value = step(value)
        if ok(value):
            return value


def surrogate(kind: str, value: str, key: bytes, tweak: int = 0) -> str:
    """The replacement of a canonical value, canonical itself."""
    t, more = f"{kind}:{tweak}", tweak // TRIES
    if kind == "card":
        valid = luhn(value)
        grown = next(v for v in (_grown(value, more)[:-1] + d if more else value for d in "0123456789") if luhn(v) == valid)
        return _walk(grown, lambda v: permute_text(v, key, t), lambda v: luhn(v) == valid)
    if kind == "ip":
        n = permute(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, key, t)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "phone":
        code, _, rest = value.rpartition(":")
        return f"{code}:{permute_text(_grown(rest, more), key, f'{t}:{code}')}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{permute_text(_grown(local, more), key, f'{t}:{domain}')}@{domain_surrogate(domain, key)}"
    if kind.startswith("given:"):
        _, script, gender = kind.split(":")
        names = GIVEN[script, gender]
        if value in names and not more:
            return names[permute(names.index(value), len(names), key, t)]
        return permute_text(_grown(value, more - 1), key, t)
    return permute_text(_grown(value, more), key, t)


def _grown(value: str, more: int) -> str:
    """value with so many characters more, of the class of its last letter or digit."""
    last = next(filter(None, map(class_of, reversed(value))), CLASSES[1])
    return value + last[0] * max(0, more)


def domain_surrogate(domain: str, key: bytes) -> str:
    """A domain with its labels permuted but for the last; domains reserved for examples stay."""
    head, _, last = domain.rpartition(".")
    return domain if RESERVED.search(domain) else f"{permute_text(head, key, f'domain:{last}')}.{last}"


def _script(name: str) -> str:
    """latin, cyrillic, hangul, ...: the first word of the first letter's Unicode name."""
    return unicodedata.name(name[0], "unknown").split()[0].lower()


def detect(text: str | None) -> list[Entity]:
    """Entities of a text by start; none overlaps another."""
    found: list[Entity] = []
    if not text:
        return found
    if "@" in text:
        found += [("email", m.start(), m.end(), m[0].lower()) for m in EMAIL.finditer(text)]
    if DIGITS.search(text):
        found += [("ip", m.start(), m.end(), ".".join(str(int(x)) for x in m[0].split("."))) for m in IP.finditer(text)]
        for m in PHONE.finditer(text):
            if m[0][0] == "+":
                # the country code: up to the first separator, or else one digit
                code = re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d)", m[0])
                code, rest = (code[1] or code[2]), m[0][code.end() :]
            else:
                code, rest = "", m[0]
            digits = re.sub(r"\D", "", rest)
            if len(digits) + len(code) >= 9:
                found.append(("phone", m.start(), m.end(), f"{code}:{digits}"))
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19:
                found.append(("card", m.start(), m.end(), digits))
    if NAME_HINT.search(text):
        for m in NAME.finditer(text):
            first, last = (m.span(2), m.span(3)) if m[1] else (m.span(4), m.span(5))
            a, b = text[slice(*first)], text[slice(*last)] if last[0] >= 0 else ""
            gender = _GENDER[a][1] if a in _GENDER else TITLES.get(m[1], "")
            if b or a in _GENDER:
                kind = f"given:{_script(a)}:{gender}" if a in _GENDER else f"name:{_script(a)}"
                found.append((kind, *first, a))
            else:
                found.append((f"name:{_script(a)}", *first, a))
            if b:
                found.append((f"name:{_script(b)}", *last, b))
    if CUE_HINT.search(text):
        for m in CUED.finditer(text):
            for part in re.finditer(_CAPITAL, m[0][(m.start(1) if m[1] else m.start(3)) - m.start() :]):
                if part[0] in STOP:
                    break
                at = (m.start(1) if m[1] else m.start(3)) + part.start()
                kind = f"given:{_script(part[0])}:{_GENDER[part[0]][1]}" if part[0] in _GENDER else f"name:{_script(part[0])}"
                found.append((kind, at, at + len(part[0]), part[0]))
    found.sort(key=lambda e: (e[1], -e[2]))
    out = _apart(found)
    more = _mentioned(text, out)
    return _apart(sorted(out + more, key=lambda e: (e[1], -e[2]))) if more else out


def _apart(found: list[Entity]) -> list[Entity]:
    """The entities, sorted by start, that overlap none before them."""
    out: list[Entity] = []
    for e in found:
        if not out or e[1] >= out[-1][2]:
            out.append(e)
    return out


def _mentioned(text: str, found: list[Entity]) -> list[Entity]:
    """Other mentions of the found name parts, none of which overlaps a found entity: one pass over the text's words, and
    one for parts in scripts without capitals, which need not stand as words."""
    kinds: dict[str, str] = {}
    for kind, _, _, value in found:
        if kind.startswith(("given:", "name:")):
            kinds.setdefault(value, kind)
    if not kinds:
        return []
    out = [(kinds[m[0]], m.start(), m.end(), m[0]) for m in WORDS.finditer(text) if m[0] in kinds]
    plain = [v for v in kinds if v[0].lower() == v[0].upper()]
    if plain:
        search = ahocorasick.Automaton()
        for v in plain:
            search.add_word(v, v)
        search.make_automaton()
        out += [(kinds[v], end + 1 - len(v), end + 1, v) for end, v in search.iter(text)]
    out = _apart(sorted(set(out), key=lambda e: (e[1], -e[2])))
    kept, k = [], 0
    for e in out:  # both in order of start, neither overlaps itself
        while k < len(found) and found[k][2] <= e[1]:
            k += 1
        if k == len(found) or found[k][1] >= e[2]:
            kept.append(e)
    return kept


def _in_format(kind: str, original: str, new: str) -> str:
    """A canonical surrogate in the original's format."""
    if kind in ("phone", "card"):
        digits = iter(new.rpartition(":")[2] if kind == "phone" else new)
        skip = len(new.partition(":")[0]) if kind == "phone" else 0
        out = []
        for c in original:
            if not c.isdigit():
                out.append(c)
            elif skip:
                skip -= 1
                out.append(c)
            else:
                out.append(next(digits))
        return "".join([*out, *digits])  # a grown domain has more
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if len(original) == len(new) else new
    return new


def replace(text: str | None, key: bytes, tweaks: dict[tuple[str, str], int] | None = None) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds of what was replaced."""
    out, at, kinds, entities = [], 0, [], detect(text)
    if not entities:
        return text, kinds
    for kind, a, b, value in entities:
        new = surrogate(kind, value, key, (tweaks or {}).get((kind, value), 0))
        out += [text[at:a], _in_format(kind, text[a:b], new)]
        at = b
        kinds.append(kind.partition(":")[0])
    return "".join(out) + text[at:], kinds


def _mentions(rows: DataFrame) -> DataFrame:
    """pii__id, kind, value: the distinct entities of each row of (pii__id, pii__text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, values = [], [], []
            for i, text in enumerate(batch.column("pii__text")):
                for kind, value in sorted({(e[0], e[3]) for e in detect(text.as_py())}):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("pii__id").take(pa.array(ids, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["pii__id", "kind", "value"])

    return rows.mapInArrow(run, f"pii__id {rows.schema['pii__id'].dataType.simpleString()}, kind string, value string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """entities (kind, value, tweak) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, v, key, t) for k, v, t in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "tweak")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], ["kind", "value", "tweak", "surrogate"])

    return entities.select("kind", "value", "tweak").mapInArrow(run, "kind string, value string, tweak int, surrogate string")


#: Entities written alike, among which surrogates must differ.
SPACE = "CASE WHEN kind LIKE 'given:%' OR kind LIKE 'name:%' THEN 'name' ELSE kind END"


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """Surrogates of distinct entities (kind, value): kind, value, tweak, surrogate, where none collides.

    A surrogate collides if it is an original of its space, or another entity's surrogate. Each round draws the colliding
    entities again, a small and shrinking part, and looks their surrogates up among the originals and those accepted.
    """
    spaced = lambda df: df.withColumn("space", F.expr(SPACE))
    originals = spaced(entities.select("kind", F.col("value").alias("surrogate"))).select("space", "surrogate").distinct()
    accepted, pending = None, entities.select("kind", "value", F.lit(0).alias("tweak"))
    while True:
        drawn = scratch(spaced(_drawn(pending, key)), "piidraw")
        met = drawn.select("space", "surrogate").join(originals, ["space", "surrogate"], "left_semi").where(f"space <> 'ip' or {int(accepted is None)} = 1")
        if accepted is not None:
            met = met.unionByName(accepted.select("space", "surrogate").join(drawn.select("space", "surrogate"), ["space", "surrogate"], "left_semi"))
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        free = first.join(met.distinct(), ["space", "surrogate"], "left_anti")
        checked = drawn.join(free, ["space", "surrogate"], "left").withColumn("ok", F.coalesce(F.col("first") == F.struct("kind", "value"), F.lit(False)))
        checked = scratch(checked.select("space", "kind", "value", "tweak", "surrogate", "ok"), "piicheck")
        drop(drawn)
        fine = checked.where("ok").drop("ok")
        accepted = fine if accepted is None else accepted.unionByName(fine)
        pending = checked.where("not ok").select("kind", "value", (F.col("tweak") + 1).alias("tweak"))
        if pending.isEmpty():
            return accepted.drop("space")


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with surrogates in the text, and pii__kinds, the kinds replaced, in order.

    Surrogates are checked against all documents' entities; two passes detect, so that texts are not moved, unless more
    than MAX_SENT entities were drawn again: then documents get theirs by a join on the id.
    """
    mentions = scratch(_mentions(docs.select(F.col(id_column).alias("pii__id"), F.col(text_column).alias("pii__text"))), "piimentions")
    given = assign(mentions.select("kind", "value").distinct(), key)
    later = scratch(given.where("tweak > 0").select("kind", "value", "tweak"), "piilater")
    sent, none = {}, F.lit(None).cast("array<struct<kind:string,value:string,tweak:int>>")
    if later.count() <= MAX_SENT:
        sent = {(r.kind, r.value): r.tweak for r in later.collect()}
        rows = docs.withColumn("pii__tweaks", none)
    else:
        by_row = mentions.join(later, ["kind", "value"]).groupBy("pii__id").agg(F.collect_set(F.struct("kind", "value", "tweak")).alias("pii__tweaks"))
        rows = docs.join(by_row, docs[id_column].eqNullSafe(by_row["pii__id"]), "left").drop("pii__id")
    names, shared = rows.columns, docs.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for text, tweaks in zip(batch.column(text_column), batch.column("pii__tweaks")):
                t = {(x["kind"], x["value"]): x["tweak"] for x in tweaks.as_py()} if tweaks.is_valid else shared.value
                new, k = replace(text.as_py(), key, t)
                texts.append(new)
                kinds.append(k)
            put = {text_column: pa.array(texts, pa.string()), "pii__tweaks": pa.array(kinds, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([put.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    schema = ", ".join(f"`{f.name}` {'array<string>' if f.name == 'pii__tweaks' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema).withColumnRenamed("pii__tweaks", "pii__kinds")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is fixed here so that runs can be compared; in use it is the caller's secret."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, b"massloom example key")
    count = lambda kind: F.size(F.filter("pii__kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *[count(k) for k in ("email", "phone", "card", "ip", "given", "name")])
