"""Secret scans by assignment-aware lexing.

Base patterns find assignments of long values to telling names, access key ids and long hexadecimal runs. The lexer adds
what patterns miss: it reads a text as source or configuration (names, strings, numbers, operators, comments), makes
name-literal pairs from assignments (name = "x", name: x, name: type = "x", "name": "x", key "x" => ...; the results of calls and elements of
arrays are no literals), joins adjacent and added string
literals, propagates constants (b = a gives b the literal of a, in order of the text), and scores each literal by how
sensitive its target's name is and how random the literal looks. A value that several parts build up keeps the places of
all of them, by reference, so that constants that double do not; its look is judged by its first VALUE characters. Pairs of score SCORE or more become spans of kind lexed.

Edge cases: a null text is empty; repeated rows are scanned alike; spans that begin alike stand in the order of KINDS;
an unclosed comment or quote is read as text, very long texts in time proportional to their length; names that clash don't matter, only id and text are
read; an empty table gives an empty result. Texts are read whole; a text without any trigger costs one search.
"""

from __future__ import annotations


import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")
Span = tuple[str, int, int]

#: How telling a part of a name is, and parts that say that the literal is no secret itself.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authorization": 0.7, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "key": 0.5, "cookie": 0.4, "session": 0.4, "salt": 0.5, "private": 0.3, "access": 0.3, "api": 0.3}
HARMLESS = {"public", "count", "length", "size", "max", "min", "limit", "name", "id", "type", "file", "path", "url", "expires", "ttl", "timeout", "hint", "label", "field", "column", "policy", "regex", "pattern"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|change.?me|your.*|example.*|test|dummy|none|null|true|false|todo|password|secret|token)$")
SCORE = 1.0
#: Characters of a value put together from several parts that its look is judged by.
VALUE = 4096

TRIGGER = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|signature|cookie|session|salt")
LEX = re.compile(
    r"""(?P<comment>//[^\n]*|\#(?!\{)[^\n]*)|(?P<open>/\*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+,;(){}\[\]])"""
    r"""|(?P<feed>\n)|(?P<other>[^\s\w"'`\#/=:+,;(){}\[\]!<>$]+|.)""",
    re.A | re.S,
)
BARE = re.compile(r"[^\s,;\"'`(){}\[\]]+")
#: What a quote that nothing closes runs through: no later quote of its kind before that end is closed either.
UNCLOSED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.S) for q in "\"'"}
#: Letters before a quote that say what kind of string it is.
PREFIXES = {"f", "r", "b", "u", "rb", "br", "fr", "rf"}
#: Tokens of a type between a name's colon and its equals sign.
TYPE = 12


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind; a match that is too short is used up, not searched again."""
    out: list[Span] = []
    folded = text if TRIGGER.search(text) else ""
    out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(folded) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def name_parts(name: str) -> list[str]:
    """Lower-case parts of a name: at signs, digits and changes of case."""
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def sensitivity(name: str) -> float:
    """0 to 1: by the most telling part, or two parts together (api key, access key, private key)."""
    parts = name_parts(name)
    joined = [a + b for a, b in zip(parts, parts[1:])]
    most = max((SENSITIVE.get(x, 0.0) for x in parts + joined), default=0.0)
    return most * (0.4 if parts and parts[-1] in HARMLESS else 1.0)


def randomness(literal: str) -> float:
    """0 to 1: Shannon entropy a character over 4 bits, less for short literals, 0 for placeholders and prose."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or re.search(r"\s", literal):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / 4) * min(1.0, n / 12)


def score(name: str, literal: str) -> float:
    """Above SCORE: a sensitive name with a literal that is random enough; randomness alone does not do."""
    s, r = sensitivity(name), randomness(literal)
    return s + r if s >= 0.5 and r > 0.2 else 0.0


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    at, last, open_to = 0, text.rfind("*/"), {q: 0 for q in UNCLOSED}
    while at < len(text):
        if at < open_to.get(text[at], 0):
            at += 1
            continue
        m = LEX.match(text, at)
        if m.lastgroup == "other" and m[0] in UNCLOSED:
            open_to[m[0]] = UNCLOSED[m[0]].match(text, m.end()).end()
        at = m.end()
        if m.lastgroup == "open":
            if at <= last:  # a comment that ends; else its two signs are text
                at = text.index("*/", at) + 2
        elif m.lastgroup not in ("comment", "other"):
            yield m.lastgroup, m[0], m.start(), m.end()


def value_at(toks: list, i: int) -> int | None:
    """Where the value of the name at i begins: behind =, :, := or =>, or behind a type (name: type = value)."""
    if i + 2 >= len(toks) or toks[i + 1][1] not in ("=", ":", ":=", "=>"):
        return None
    if toks[i + 1][1] == ":":
        depth, last = 0, None
        for j in range(i + 2, min(i + 2 + TYPE, len(toks) - 1)):
            kind, value, _, _ = toks[j]
            if value == "=" and depth == 0 and last:
                return j + 1
            depth += (value == "[") - (value == "]")
            if not (value in ("[", "]") or (kind == "name" and last != "name") or (value == "," and depth > 0)):
                break
            last = kind if value != "]" else "]"
    return i + 2


def pairs(text: str) -> list[tuple[str, str, list]]:
    """(name, literal, sources) of the text's assignments in order; constants stand for the literals they hold.

    sources are spans (start, end) and, for constants, the lists of their own sources: see spans_of().
    """
    out, known = [], {}
    toks = list(tokens(text))
    for i, (kind, value, _, _) in enumerate(toks):
        if kind == "name":
            name = value
        elif kind == "string":
            name = value[1:-1]
            if not re.fullmatch(r"[\w.$-]{1,80}", name, re.A):
                continue
        else:
            continue
        j, literal, sources, end = value_at(toks, i), "", [], -1
        while j is not None and j < len(toks):
            k, v, a, b = toks[j]
            after = toks[j + 1] if j + 1 < len(toks) else (None, None, None, None)
            if k == "name" and after[0] == "string" and after[2] == b and v.lower() in PREFIXES:
                j += 1
                continue
            if k == "string":
                part, where, to = v[1:-1], (a, b), b
            elif k == "name" and v in known and not (j + 1 < len(toks) and toks[j + 1][1] in ("=", ":", "(")):
                part, where = known[v]
                to = b
            elif k in ("name", "number") and not sources and not (after[1] in ("(", "[") and after[2] == b):  # a call or an element is no literal
                part = BARE.match(text, a)[0]  # an unquoted value of a configuration file
                where, to = (a, a + len(part)), max(b, a + len(part))
                if part[-1] in ":=":  # the next pair's name
                    break
            else:
                break
            literal = (literal + part)[:VALUE] if sources else part
            sources.append(where)
            end = to
            j += 1
            while j < len(toks) and toks[j][2] < end:
                j += 1
            if j < len(toks) and toks[j][1] == "+":
                j += 1
            elif not (j < len(toks) and toks[j][0] == "string" and k == "string"):
                break
        if sources:
            known[name] = (literal, sources)
            out.append((name, literal, sources))
    return out


def spans_of(sources: list, seen: set[int]) -> list[tuple[int, int]]:
    """The spans of sources and of all that they refer to; what is in seen, by identity, was given before."""
    out, left = [], [sources]
    while left:
        now = left.pop()
        if isinstance(now, tuple):
            out.append(now)
        elif id(now) not in seen:
            seen.add(id(now))
            left += now
    return out


_ASSIGNING = re.compile(r"[=:]")


def lexed_spans(text: str) -> list[Span]:
    """Spans of literals that score SCORE or more for their name."""
    if not TRIGGER.search(text) or not _ASSIGNING.search(text):
        return []
    # lines without = or : have no pair; what is left is lexed as one text, so constants reach every later line
    lines = [m for m in re.finditer(r"[^\n]+", text) if _ASSIGNING.search(m[0])]
    whole, at, places, ends = "\n".join(m[0] for m in lines), 0, [], []
    for m in lines:
        ends.append(at)
        places.append(m.start())
        at += len(m[0]) + 1

    def back(p: int) -> int:
        i = bisect.bisect_right(ends, p) - 1
        return p - ends[i] + places[i]

    out, seen = [], set()
    found = pairs(whole)
    for name, literal, sources in found:
        if score(name, literal) >= SCORE:
            out += [("lexed", back(a), back(b - 1) + 1) for a, b in spans_of(sources, seen)]
    return sorted(set(out), key=order)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + lexed_spans(text), key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, base and spans: arrays of (kind, start, end), in code points, ends exclusive."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column("text"):
                b, s = scan(text.as_py())
                base.append([{"kind": k, "start": i, "end": j} for k, i, j in b])
                every.append([{"kind": k, "start": i, "end": j} for k, i, j in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, b in sorted(scan(text)[1], key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
