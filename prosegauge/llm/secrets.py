"""Operator 10: secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
#: A text without any of these (in lower case) has no assign match.
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of a target's name, split at case changes and signs, and how much they say.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "authorization": 0.7,
    "signature": 0.5, "salt": 0.5, "private": 0.4, "access": 0.3, "api": 0.3, "encryption": 0.3, "key": 0.4,
}
#: Names that speak of a secret without holding it.
HARMLESS = {"count", "length", "size", "limit", "name", "type", "policy", "hint", "expiry", "ttl", "file", "path", "url"}
_PLACEHOLDER = re.compile(r"(?i)^(?:changeme|change_me|example|sample|dummy|placeholder|redacted|none|null|true|false|"
                          r"undefined|todo|test|password|secret|token|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|(.)\1*)$")
#: A literal's score from which it is reported.
THRESHOLD = 1.5

_LEX = re.compile(r"""
    (?P<comment>/\*|\*/)
  | (?P<quote>["'`])
  | (?P<op>:=|=>|==|!=|<=|>=|[=:])
  | (?P<join>\+|\.\.)
  | (?P<name>[^\W\d][\w$-]*(?:\.[^\W\d][\w$-]*)*)
  | (?P<bare>[^\s"'`,;=:(){}\[\]<>]+)
  | (?P<end>[,;\n])
  | (?P<other>[^\s])
""", re.VERBOSE)
_STRINGS = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}") for q in "\"'"} | {"`": re.compile(r"`[^`\n]*`")}
#: Words before a name that make what follows its colon a statement, not a type.
_STATEMENTS = frozenset("if elif else while for with in and or not is case when except return lambda default do match".split())
#: Most tokens of a type.
_TYPE = 24
#: What may be a target: a run of a name's signs, or the end of a string, before an assignment's sign.
_TARGET = re.compile(r"""(?:(?<![\w$.-])(?P<run>[\w$.-]++)\??+|["'`])[^\S\n]*+\]?+[^\S\n]*+[:=]""")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_OTHERS = bytes(set(range(256)) - set(_LETTERS))


def _name_words(name: str) -> tuple[list[str], int]:
    """Words of a name, then each two in a row as one; and how many are single."""
    words = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    return words + [a + b for a, b in zip(words, words[1:], strict=False)], len(words)


def name_score(name: str) -> float:
    """How much a target's name says that its value is secret."""
    words, single = _name_words(name)
    if HARMLESS & set(words[-1:] + words[single - 1: single]):
        return 0.0
    return _said(words)


def _said(words: list[str]) -> float:
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(words)))


def may_hold(text: str) -> bool:
    """False only for texts without a target that ``name_score`` gives 0.5 or more.

    A name is inside its run, so its words are among the run's. A string's words, without what is between letters, are
    in the text's letters.
    """
    seen, strings = set(), False
    for m in _TARGET.finditer(text):
        run = m["run"]
        if run is None:
            strings = True
        elif run not in seen:
            seen.add(run)
            if _said(_name_words(run)[0]) >= 0.5:
                return True
    if not strings:
        return False
    letters = text.encode(errors="replace").translate(None, _OTHERS).lower()
    return sum(said for word, said in SENSITIVE.items() if word.encode() in letters) >= 0.5


def literal_score(value: str) -> float:
    """From 0 to 1.5: length, entropy in bits and mixed kinds of characters."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or " " in value.strip() and len(value.split()) > 4:
        return 0.0
    return _strength(len(value), Counter(value))


def _strength(n: int, counts: Counter) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    signs = "".join(counts)
    kinds = sum(bool(re.search(p, signs)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return min(1.0, entropy * n / 60) + (0.25 if kinds > 1 else 0) + (0.25 if kinds > 2 else 0)


class Value:
    """What an assignment gives: literals (start, end, text) and values of earlier constants, in order."""

    __slots__ = ("parts", "sums")

    def __init__(self) -> None:
        self.parts: list[tuple[int, int, str] | Value] = []
        self.sums: tuple | None = None


#: Signs of a value's head and tail that are kept: no shorter than any whole placeholder.
_EDGE = 16


def _sums(text: str) -> tuple:
    """Of a text: signs, counts of each, words (up to 10), head and tail."""
    return len(text), Counter(text), min(len(text.split()), 10), text[:_EDGE], text[-_EDGE:]


def _joined(one: tuple, two: tuple) -> tuple:
    n, counts, words, head, tail = one
    m, more, others, first, last = two
    if not n or not m:
        return two if not n else one
    counts = counts + more
    touching = not tail[-1].isspace() and not first[0].isspace()
    if n + m > 1 << 300:  # chains of doublings: only the shares count any more
        counts = Counter({s: max(1, c >> 100) for s, c in counts.items()})
    return (sum(counts.values()), counts, min(words + others - touching, 10),
            head if n >= _EDGE else (head + first)[:_EDGE], last if m >= _EDGE else (tail + last)[-_EDGE:])


def value_score(value: Value) -> float:
    """``literal_score`` of the joined literals, from sums: a constant is summed once, however often it is used."""
    open_ = [value]
    while open_:
        top = open_[-1]
        waiting = [p for p in top.parts if isinstance(p, Value) and p.sums is None] if top.sums is None else []
        if waiting:
            open_ += waiting
            continue
        open_.pop()
        if top.sums is None:
            total = _sums("")
            for p in top.parts:
                total = _joined(total, p.sums if isinstance(p, Value) else _sums(p[2]))
            top.sums = total
    n, counts, words, head, tail = value.sums
    if n <= _EDGE:
        return literal_score(head)
    short = head + tail if n >= 2 * _EDGE else head + tail[2 * _EDGE - n:]
    placeholder = _PLACEHOLDER.match(short)
    same = len({s.lower() for s in counts}) == 1
    if placeholder and (placeholder[1] is None or same):
        return 0.0
    if words > 4 and " " in counts:
        return 0.0
    return _strength(n, counts)


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each token. A quote that its line does not close is a sign of its own; once one is found,
    no later quote of its kind on that line is tried, as it would end at the same place."""
    out: list[tuple[str, int, int]] = []
    at, open_until = 0, dict.fromkeys(_STRINGS, -1)
    while m := _LEX.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            kind = "other"
            if start >= open_until[text[start]]:
                if whole := _STRINGS[text[start]].match(text, start):
                    kind, at = "string", whole.end()
                else:
                    line = text.find("\n", start)
                    open_until[text[start]] = len(text) if line < 0 else line
        out.append((kind, start, at))
    return out


def _annotated(text: str, tokens: list[tuple[str, int, int]], i: int) -> str:
    """The name in ``name: T =`` or ``name?: T =``, whose ``=`` is token i; empty if there is none."""
    at = i - 1
    while at > 0 and i - at < _TYPE and tokens[at][0] in ("name", "bare", "other", "join"):
        at -= 1
    if at < 1 or at == i - 1 or text[tokens[at][1]: tokens[at][2]] != ":" or "\n" in text[tokens[at][1]: tokens[i][1]]:
        return ""
    at -= 1
    if at > 0 and text[tokens[at][1]: tokens[at][2]] == "?":
        at -= 1
    kind, start, end = tokens[at]
    if kind != "name" or (at > 0 and tokens[at - 1][0] == "name" and text[tokens[at - 1][1]: tokens[at - 1][2]] in _STATEMENTS):
        return ""
    return text[start:end]


def pairs(text: str) -> list[tuple[str, Value]]:
    """Name-value pairs in order: each assignment's target and the literals and constants that its value comes from.

    Reads ``name = "x"``, ``name: x``, ``"name": "x"``, ``name => x``, ``cfg["name"] = x`` and typed ``name: T = x``;
    the value is literals and names of earlier constants, joined by + or '..'. A bare value must hold a digit.
    """
    tokens = tokens_of(text)
    known: dict[str, Value] = {}
    out, i, n = [], 0, len(tokens)

    def inner(at: int) -> str:
        return text[tokens[at][1] + 1: tokens[at][2] - 1]

    while i < n:
        kind, start, end = tokens[i]
        if kind != "op" or text[start:end] in ("==", "!=", "<=", ">=") or i == 0:
            i += 1
            continue
        before = i - 1
        if text[tokens[before][1]: tokens[before][2]] == "]" and before > 1:
            before -= 1  # cfg["name"]
        target = ""
        if tokens[before][0] == "name":
            target = text[tokens[before][1]: tokens[before][2]]
        elif tokens[before][0] == "string":
            target = inner(before)
        if text[start:end] == "=":
            target = _annotated(text, tokens, i) or target
        value = Value()
        at, parts, more = i + 1, value.parts, True
        while at < n and more:
            what, a, b = tokens[at]
            if what == "string":
                parts.append((a + 1, b - 1, text[a + 1: b - 1]))
            elif what == "name" and text[a:b] in known:
                parts.append(known[text[a:b]])
            elif what in ("name", "bare"):
                stop = at  # a bare value runs on to white space
                while stop + 1 < n and tokens[stop + 1][1] == tokens[stop][2] and tokens[stop + 1][0] in ("name", "bare", "join"):
                    stop += 1
                b = tokens[stop][2]
                if "\n" not in text[end:a] and re.search(r"\d", text[a:b]):
                    parts.append((a, b, text[a:b]))
                at = stop
            else:
                break
            more = at + 1 < n and tokens[at + 1][0] == "join"
            at += 1 + more
        if target and parts:
            known[target] = value
            out.append((target, value))
        elif target:
            known.pop(target, None)  # no longer what it was
        i += 1
    return out


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target, by start."""
    if not may_hold(text):
        return []
    found, seen = set(), set()
    for target, value in pairs(text):
        named = name_score(target)
        if named >= 0.5 and named + value_score(value) >= THRESHOLD:
            open_ = [value]
            while open_:  # each constant once in the whole text
                top = open_.pop()
                if id(top) not in seen:
                    seen.add(id(top))
                    open_ += [p for p in top.parts if isinstance(p, Value)]
                    found.update(p[:2] for p in top.parts if not isinstance(p, Value) and p[1] > p[0])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in BASE_KINDS, end), in order."""
    spans = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    base = base_spans(text) if text else []
    joined = ",".join(f"{BASE_KINDS[k]}:{a}:{b}" for a, k, b in base)
    counts = Counter(k for _, k, _ in base)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and reach[k - 1] >= b
    more = [(a, 3, b) for a, b in literals(text) if not inside(a, b)] if text else []
    every = sorted(base + more)
    spans = joined if not more else ",".join(f"{(*BASE_KINDS, 'literal')[k]}:{a}:{b}" for a, k, b in every)
    return counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest(), spans


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole ``text`` (null: empty), one row for each input row, in one narrow stage.

    The base kinds assign, access and hex are always reported. The lexer adds kind ``literal``: literals whose value
    reaches a target with a sensitive name, also through constants, and that are not inside a base span. Columns:
    doc_id (null stays null), n_assign, n_access, n_hex, base_sha256 (of kind:start:end, code points, by start then
    kind), spans (all of them likewise; empty if none). Repeated rows give repeated rows; other columns are not read.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return docs.select("doc_id", "text").mapInArrow(find, schema)
