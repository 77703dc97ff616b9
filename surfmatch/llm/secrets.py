r"""Secret scans (operator 2): base patterns, and assignment-aware lexing.

Base spans are the three fixed patterns. The lexer then reads name-literal pairs
out of source and configuration syntax, remembers what each name was bound to, follows
names used as values, ``+`` chains of them and names inside ``f"{x}"`` and `` `${x}` ``, and scores
each literal by how sensitive the name is that it reaches. It reads
``name = "x"``, ``name: type = "x"``, ``name: x``, ``"name": "x"``, ``name := x``, ``name => x``,
``<name>x</name>``, ``key="name" value="x"``, ``f("name", "x")``, ``#define name x``, ``ENV name x`` and
block scalars of YAML; literals may be quoted by ", ', \`, or three quotes over many lines,
carry a prefix of one or two letters, and stand side by side. Literals that score enough and lie
inside no base span are added with kind ``lexed``; they may overlap base spans. The least score
of 5 is what a name like ``password`` (3) needs from a mixed literal of six characters.
A literal without quotes counts only if it holds digits and letters.

Cases: null or empty text gives no spans. Rows are independent, so repeated rows,
null ids and empty tables need no rule. Names and values may have any length, and long
texts cost time and memory in proportion: constants are kept by reference, each is
looked at once, and no text is read again for each name inside it. Of a name bound twice
the last binding before its use counts.

There is no oracle SQL: DuckDB has no leftmost non-overlapping spans with places, and
no lexer. Tests hold base spans against brute force and lexed ones against planted text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from surfmatch.llm.common import pick, small_batches

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A name, and the operator that binds it; the empty group is where the value starts if a type stands between. Every part gives nothing back, so text is read once.
TARGET = re.compile(
    r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)["']?\]?[ \t]*+"""
    r"""(?::=|=>|=(?!=)|:(?!//)(?=[ \t]*+&?+(?:'[a-z]++[ ])?+[A-Za-z_][\w.<>\[\]?*]*+[ \t]*+=(?![=>])())?)"""
)
#: Other places where a name meets a value: the value is the last group, or the term that follows.
ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
PAIR = re.compile(r"""\b(?:key|name)=["']([^"'<>\n]*+)["']\s++value=["']([^"'<>\n]*+)["']""")
CALL = re.compile(r"""\(\s*+["']([A-Za-z_][\w.\-]*+)["']\s*+,(?=[ \t]*+[A-Za-z@$]{0,2}["'`])""")
DIRECTIVE = re.compile(r"^[ \t]*+(?:#[ \t]*+define|ENV|setenv|SetEnv)[ \t]++([A-Za-z_]\w*+)(?=[ \t])", re.M)
SCALAR = re.compile(r"""^([ \t]*+)(?:-[ ]++)?+["']?([A-Za-z_][\w.\-]*+)["']?[ \t]*+:[ \t]*+[|>][+\-0-9]*+[ \t]*+\r?\n""", re.M)

TERM = re.compile(
    r"""[ \t]*+(?:([A-Za-z@$]{0,2}+)(?:(\"\"\"|\'\'\')|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)|([A-Za-z0-9_+/.=\-]+))""", re.S
)
#: A bare word inside an earlier bare word: it ends where names may start.
INNER = re.compile(r"[+/=]*+[A-Za-z0-9_.\-]*+")
PLUS = re.compile(r"[ \t]*+\+(?=[ \t]*+[\"'`A-Za-z_])")
BESIDE = re.compile(r"[ \t]++(?=[A-Za-z@$]{0,2}[\"'])")
HOLE = re.compile(r"\$?\{([A-Za-z_][\w.]*+)\}")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|todo|changeme|example.*|your[-_].*|<.*>|\$\{.*\}|\{\{.*\}\}|env\..*|process\.env.*|os\.environ.*)$")

#: Parts of names and how strongly each marks a value as secret.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 3.0, "apikey": 3.0,
    "privatekey": 3.0, "accesskey": 3.0, "secretkey": 3.0, "credential": 2.5, "credentials": 2.5, "bearer": 2.5,
    "authkey": 2.5, "signingkey": 2.5, "encryptionkey": 2.5, "connectionstring": 2.0, "dsn": 1.5, "auth": 1.5, "pass": 1.5, "key": 1.0,
}
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target name is: its best part, or two neighbouring parts read as one."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


class Profile(NamedTuple):
    """What the score of a literal needs to know; profiles of joined literals add up."""

    n: float  # characters, 1e9 at most
    shares: dict[int, float]  # of characters, by code point modulo 128
    classes: int  # bits: digits, lower and upper case, others
    spaced: bool
    placeholder: bool


def profile(value: str) -> Profile:
    n = len(value)
    shares = {c: k / n for c, k in Counter(ord(c) % 128 for c in value).items()}
    classes = sum(any(map(f, value)) << i for i, f in enumerate((str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())))
    return Profile(n, shares, classes, " " in value.strip(), not value or bool(PLACEHOLDER.match(value)))


def joined(profiles: Iterable[tuple[Profile, int]]) -> Profile:
    """The profile of literals joined, each given with how often it stands there."""
    n, weights, classes, spaced, placeholder = 0.0, Counter(), 0, False, True
    for p, times in profiles:
        n += times * p.n
        for c, share in p.shares.items():
            weights[c] += times * p.n * share
        classes, spaced, placeholder = classes | p.classes, spaced or p.spaced, placeholder and p.placeholder
    return Profile(min(n, 1e9), {c: w / n for c, w in weights.items()}, classes, spaced, placeholder)


def literal_score(p: Profile) -> float:
    """How much a literal looks like key material: length, entropy and mixed classes; placeholders score nothing."""
    if p.n < 6 or p.placeholder or p.spaced and p.n < 20:
        return 0.0
    entropy = -sum(s * math.log2(s) for s in p.shares.values() if s > 0)
    return min(p.n, 32) / 16 + entropy / 2 + (p.classes.bit_count() - 1) * 0.75


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Literal(NamedTuple):
    value: str
    start: int
    end: int
    quoted: bool


class Bound:
    """What a name is bound to: literals and earlier bindings, joined in order.

    Earlier bindings are kept by reference, so a text of chained constants takes
    memory in proportion to its length, whatever it would expand to.
    """

    __slots__ = ("parts", "known", "told", "bare")

    def __init__(self, parts: list):
        self.parts, self.known, self.told = parts, None, False
        self.bare = not any(isinstance(p, Bound) or p.quoted for p in parts)

    def profile(self) -> Profile:
        todo = [(self, False)]
        while todo:
            at, ready = todo.pop()
            if at.known is not None:
                continue
            earlier = Counter(p for p in at.parts if isinstance(p, Bound))
            if not ready:  # those it refers to first, each once
                todo.append((at, True))
                todo += [(p, False) for p in earlier if p.known is None]
                continue
            at.known = joined([*((profile(p.value), 1) for p in at.parts if not isinstance(p, Bound)), *((p.known, k) for p, k in earlier.items())])
        return self.known

    def spans(self) -> Iterator[tuple[int, int]]:
        """The places of all literals that reach this binding and were not told before."""
        todo = [self]
        while todo:
            at = todo.pop()
            if not at.told:
                at.told = True
                for p in at.parts:
                    if isinstance(p, Bound):
                        todo.append(p)
                    else:
                        yield p.start, p.end


def targets(text: str) -> list[tuple[int, str, int, list[Literal] | None]]:
    """(place of the name, name, where its value starts, the value where the form tells it) in text order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(1), m[1], m.end() if m.start(2) < 0 else m.start(2), None) for m in TARGET.finditer(text)]
    if "</" in text:
        found += [(m.start(), m[1], m.start(2), [Literal(m[2], *m.span(2), False)]) for m in ELEMENT.finditer(text)]
    if "value=" in text:
        found += [(m.start(), m[1], m.start(2), [Literal(m[2], *m.span(2), True)]) for m in PAIR.finditer(text)]
    if "(" in text and "," in text:
        found += [(m.start(), m[1], m.end(), None) for m in CALL.finditer(text)]
    if "define" in text or "ENV" in text or "etenv" in text or "etEnv" in text:
        found += [(m.start(), m[1], m.end(), None) for m in DIRECTIVE.finditer(text)]
    if "|" in text or ">" in text:
        end = 0
        for m in SCALAR.finditer(text):
            if m.start() < end:
                continue  # a line of the block before
            lines, end = [], m.end()
            while end < len(text):
                stop = text.find("\n", end) + 1 or len(text)
                line = text[end:stop]
                value = line.strip()
                if value:
                    start = end + line.index(value)
                    if start - end <= len(m[1]):
                        break
                    if not re.search(r"\s", value):
                        lines.append(Literal(value, start, start + len(value), False))
                end = stop
            if lines:
                found.append((m.start(), m[2], m.end(), lines))
    return sorted(found, key=lambda t: t[0])


def pieces(value: str, start: int, bound: dict[str, Bound]) -> Iterator[Literal | Bound]:
    """The literal parts of a quoted text with holes, and the bindings that fill them."""
    at = 0
    for m in HOLE.finditer(value):
        if m.start() > at:
            yield Literal(value[at : m.start()], start + at, start + m.start(), True)
        if m[1] in bound:
            yield bound[m[1]]
        at = m.end()
    if at < len(value):
        yield Literal(value[at:], start + at, start + len(value), True)


def name_literal_pairs(text: str) -> Iterator[tuple[str, Bound]]:
    """(name, what it is bound to) in text order."""
    bound: dict[str, Bound] = {}
    read = 0  # where the bare words read so far end
    for _, name, at, told in targets(text):
        parts: list[Literal | Bound] = list(told or ())
        while not told and (term := INNER.match(text, at) if at < read else TERM.match(text, at)):
            kind, beside = term.lastindex or 0, None
            at, value = term.end(), term[kind]
            if kind in (0, 6):
                read = max(read, at)
                parts.append(bound[value] if value in bound else Literal(value, at - len(value), at, False))
            else:
                start = term.start(kind)
                if kind == 2:
                    start = at
                    if (stop := text.find(value, at)) < 0:
                        break
                    at, value = stop + 3, text[start:stop]
                if kind == 5 or "$" in term[1] or "f" in term[1].lower():
                    parts += pieces(value, start, bound)
                else:
                    parts.append(Literal(value, start, start + len(value), True))
                beside = BESIDE.match(text, at)
            if not (more := PLUS.match(text, at) or beside):
                break
            at = more.end()
        if parts:
            # a mere other name for a binding shares it
            bound[name] = parts[0] if len(parts) == 1 and isinstance(parts[0], Bound) else Bound(parts)
            yield name, bound[name]


def lexed_spans(text: str, base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Spans that lexing adds to the base ones."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = set()
    for name, found in name_literal_pairs(text):
        if not (worth := name_score(name)):
            continue
        seen = found.profile()
        if found.bare and not (seen.classes & 1 and seen.classes & 6):
            continue  # words of prose or a plain number
        score = literal_score(seen)
        if score and worth + score >= least:
            for s, e in found.spans():
                i = bisect_right(starts, s)
                if e > s and not (i and e <= ends[i - 1]):  # outside of any base span
                    added.add((s, 3, e))
    return sorted(added)


def scan(text: str | None, least: float = 5.0) -> tuple[list, list]:
    """Base spans and added spans of one text."""
    base = base_spans(text or "")
    return base, lexed_spans(text or "", base, least)


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, least: float = 5.0) -> DataFrame:
    """doc_id, base and added spans as arrays of (kind, start, end), and the digest columns; one row per input row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans")}
            for text in batch.column(1).to_pylist():
                base, added = scan(text, least)
                kinds = Counter(k for _, k, _ in base)
                out["n_assign"].append(kinds[0])
                out["n_access"].append(kinds[1])
                out["n_hex"].append(kinds[2])
                out["n_lexed"].append(len(added))
                out["base_sha256"].append(hashlib.sha256(listing(base).encode()).hexdigest())
                out["spans"].append(listing(sorted(base + added)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()],
                ["doc_id", *out],
            )

    return pick(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string"
    )


def redact_text(text: str | None, mark: str = "[REDACTED]", least: float = 5.0) -> str | None:
    """The text with every found span replaced; overlapping spans become one mark."""
    if text is None:
        return None
    base, added = scan(text, least)
    out, at = [], 0
    for s, _, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[REDACTED]", least: float = 5.0) -> DataFrame:
    """documents with secrets replaced by a mark, n_chars counted anew; every row stays."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [redact_text(t, mark, least) for t in batch.column(1).to_pylist()]
            chars = [n if t is None else len(t) for t, n in zip(texts, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(chars, pa.int64())],
                ["doc_id", "text", "lang", "source", "n_chars"],
            )

    return pick(docs, "doc_id", "text", "lang", "source", "n_chars").mapInArrow(
        run, "doc_id long, text string, lang string, source string, n_chars long"
    )
