"""Secrets by assignment-aware lexing.

Strict patterns give base spans. Beyond them, a text is lexed as source or configuration: names, strings of
all kinds of quotes, bare values and operators. Pairs of a name and its literals are: assignments (`name =
literal`, `name: literal`, `=>`, `:=`, with a type, to an element as in `env["name"] = literal`, on the next
line, or as an indented block), elements and attributes (`<name>literal</name>`, `key="name" value="literal"`)
and calls (`set_name("literal")`, `put("name", "literal")`). A name that stands for a known constant, and
literals joined by + or by standing next to each other, take the constants' values, whatever their order in
the text. A pair's literal is scored by how sensitive its name is and by how random the
value looks; literals that reach the threshold, and the literals that a sensitive name got its value
from, are added as spans of the kind `literal`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
#: The strict patterns and least lengths (of group 2, and of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer digits fails at each of its starts, so that the least length can be in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

#: How sensitive a name is, by the parts it is made of; the largest counts.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.5}
#: Least score (sensitivity times likelihood of the value) and least characters of a literal.
LEAST_SCORE, LEAST_LENGTH = 0.45, 8

_NAMED = r"""[A-Za-z_][A-Za-z0-9_.-]*+"""
#: A name, at the begin of its run of characters, and what assigns: `a: kind = b` has its type's name too.
_HEAD = re.compile(
    rf"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>{_NAMED})["'`]?\]?[ \t]*+(?::=|=>|=(?![=~])|:(?![:/])(?:[ \t]*+[&*]*+(?P<type>[A-Za-z_][A-Za-z0-9_.]*+)"""
    rf"""(?:[\[<\]>][^\n=:\[\]<>]*+)*+\??(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[ \t]*+=(?![=~>]))?)[ \t]*+"""
)
_QUOTED = r""""{3}(?s:.)*?"{3}|'{3}(?s:.)*?'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"""
_STRING = rf"[bfruBFRU]{{0,2}}(?:{_QUOTED})"
_PREFIX = re.compile(r"[bfruBFRU]{0,2}")


def _operand(stops: str) -> re.Pattern[str]:
    """A string, or a whole run of literal characters; a run ends before a string that is joined to it, and where `stops` begin a further pair."""
    return re.compile(rf"""{_STRING}|(?:\$?\{{[A-Za-z0-9_.]*+\}}|(?!\+[ \t]*+["']|&&|[{stops}]{_NAMED}[=:])[^\s"'`,;()\[\]{{}}<>])++""")


#: Of names that are sensitive (a query string's next parameter ends a value), and of others (so does a pair within an address or path).
_OPERAND, _PLAIN_OPERAND = _operand("&"), _operand("&?#|:/@")
_JOINT = re.compile(r"\s*+\+\s*+|\s++(?=[\"'`])")
#: A value on the next line is a string or a block of indented lines.
_NEXT_LINE = re.compile(r"\\?\r?\n[ \t]*+(?=[\"'`])")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*+(?P<lines>(?:\r?\n[ \t]++\S[^\n]*+)++)")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_ELEMENT = re.compile(rf"<(?:[A-Za-z0-9_.-]*:)?(?P<name>{_NAMED})(?:\s[^<>]*+)?>\s*+(?P<value>[^<>\s][^<>]*?)\s*</")
_ATTRIBUTES = re.compile(rf"""\b(?:key|name|id)\s*+=\s*+["'](?P<name>{_NAMED})["']\s++value\s*+=\s*+(?P<value>{_QUOTED})""")
_CALL = re.compile(rf"""(?P<call>(?<![A-Za-z0-9_.-]){_NAMED})\(\s*+(?:["'](?P<key>{_NAMED})["']\s*+,\s*+)?(?P<value>{_STRING})\s*+[,)]""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NAME = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*)\}?\Z")
_PARTS = re.compile(r"[._-]")
_HINT = re.compile(r"[=:]")


def sensitivity(name: str) -> float:
    """0 to 1, from the parts of a name in camel, snake, kebab or dotted style, and from neighbours joined."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max((SENSITIVE.get(x, 0.0) for x in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def likelihood(value: str) -> float:
    """0 to 1: how much a literal looks like a secret, from its length, its entropy and its classes of characters."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    if all(x.isalpha() and (x.islower() or x.istitle() or x.isupper()) for x in _PARTS.split(value)):
        return 0.2  # words, or a path of names
    return min(1.0, entropy / min(4.0, math.log2(len(value)) + 1e-9)) * (0.55 + 0.15 * kinds)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns' matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH] if "=" in text or ":" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _unquoted(word: str, start: int) -> tuple[str, int, int]:
    """A string's content and its place."""
    skip = _PREFIX.match(word).end()
    skip += 3 if word[skip : skip + 3] in ('"""', "'''") and len(word) >= skip + 6 else 1
    close = 3 if word.endswith(('"""', "'''")) and len(word) - skip >= 3 and word[skip - 1] == word[-1] and skip > 2 and word[skip - 3] == word[-1] else 1
    return word[skip:-close], start + skip, start + len(word) - close


def _assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]], list[str]]]:
    at = 0
    while m := _HEAD.search(text, at):
        at, literals, refers = m.end(), [], []
        names = [m["name"], *([m["type"]] if m["type"] else [])]
        sensitive = any(map(sensitivity, names))
        if sensitive and (block := _BLOCK.match(text, at)):
            literals, at = [(line[0], line.start(), line.end()) for line in _LINE.finditer(text, block.start("lines"), block.end())], block.end()
        else:
            operand = _OPERAND if sensitive else _PLAIN_OPERAND
            if below := _NEXT_LINE.match(text, at):
                at = below.end()
            o = operand.match(text, at)
            while o:
                (start, at), word = o.span(), o[0]
                if word[-1] in "\"'`" and word.lstrip("bfruBFRU")[:1] == word[-1]:
                    literals.append(_unquoted(word, start))
                else:
                    literals.append((word, start, at))  # a bare word is a value too, in configurations
                    refers += [name[1] for part in word.split("+") if (name := _NAME.match(part))]
                joint = _JOINT.match(text, at)
                o = operand.match(text, joint.end()) if joint else None
        if literals:
            yield from ((name, literals, refers) for name in names)


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int]], list[str]]]:
    """(name, its literals with their places, the names it refers to) of each pair."""
    out = list(_assignments(text)) if _HINT.search(text) else []
    if "</" in text:
        out += [(m["name"], [(m["value"], *m.span("value"))], []) for m in _ELEMENT.finditer(text)]
    if "value" in text:
        out += [(m["name"], [_unquoted(m["value"], m.start("value"))], []) for m in _ATTRIBUTES.finditer(text)]
    if "(" in text:
        out += [(m["key"] or m["call"], [_unquoted(m["value"], m.start("value"))], []) for m in _CALL.finditer(text)]
    return out


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach sensitive names, directly or by constants."""
    found = pairs(text)
    known: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        known.setdefault(name, []).append(i)
    # a name's sensitivity flows to the names that it takes its value from
    weight = [sensitivity(name) for name, _, _ in found]
    stack = [i for i, w in enumerate(weight) if w > 0]
    while stack:
        i = stack.pop()
        for refer in found[i][2]:
            for j in known.get(refer, ()):
                if weight[j] < weight[i]:
                    weight[j] = weight[i]
                    stack.append(j)
    spans = set()
    for w, (_, literals, refers) in zip(weight, found, strict=True):
        if w > 0:
            joined = likelihood("".join(x for x, _, _ in literals if x not in known)) if len(literals) > 1 else 0.0
            spans |= {(start, 3, end) for value, start, end in literals if value and not all(x in refers and x in known for x in value.split("+")) and w * max(likelihood(value), joined) >= LEAST_SCORE}
    return sorted(spans)


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans; a literal within a base span adds nothing."""
    base = base_spans(text)
    added = [s for s in literal_spans(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return base, sorted(base + added)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) for each row of docs (doc_id, text).

    Counts and digest are of base spans; spans names all, by start and kind. Places count code points, ends
    exclusive. A null text is empty. Texts are lexed whole and literals taken whole, whatever their length. Spans
    of one start are in the order of their kinds. Rows that repeat a doc_id have rows each; extra columns are
    not read. An empty table gives no rows.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text or "")
                counts = Counter(k for _, k, _ in every)
                base_counts = Counter(k for _, k, _ in base)
                rows.append((*[base_counts[k] for k in range(3)], hashlib.sha256(named(base).encode()).hexdigest(), named(every), counts[3]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
