"""Secret scan by assignment-aware lexing.

Each text is read two ways:

* **base patterns**: a literal right after a sensitive word, access key ids
  and long hex runs (see ``BASE``);
* **lexing**: a small scanner reads the tokens of source and configuration
  syntax (names, dotted and subscripted names, string and bare literals,
  ``= := : =>``, ``+`` between literals, ``key: value`` lines, ``export``) into
  name-literal pairs. A name given a literal is a constant; a pair whose value
  is a known name takes that constant's literals (also through several names
  and through concatenation). A literal is scored by the sensitive words in
  every name that receives it, its length, its distinct characters and its
  character classes; from ``THRESHOLD`` on it is reported as ``lexed``, at the
  place where the literal itself stands. A concatenation is scored as one
  joined value as well, and its pieces are reported. A ``=``, ``:`` or ``+``
  at a line's end, and a ``+`` at the start of the next, go on over the line
  end unless what follows is a key of its own.

Spans are code points, end exclusive. Null and empty texts have no spans.
Names are resolved within one text, at any distance; a name bound several times
holds all the literals bound to it. In a concatenation each value of a name is
joined with the strongest values of the other names (a sum of joined values, not
their product). Rows are independent: no shuffle, a lost executor costs its own
rows only.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base kinds, in their order, and their patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
RANK = {kind: k for k, kind in enumerate(KINDS)}

# Sensitive words of target names and their weights; each reaches THRESHOLD
# with a strong literal (of weight 0.9 to 1).
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0,
             "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
             "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0,
             "bearer": 0.8, "auth": 0.7, "key": 0.7, "salt": 0.7, "signature": 0.7}
THRESHOLD = 1.6  # of a name's weight plus a literal's

_LEX = re.compile(r"""
    (?P<quote>["'`])
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|->|::|-)[A-Za-z_][A-Za-z0-9_]*)*)
  | (?P<bind>:=|=>|==|!=|<=|>=|=|:)
  | (?P<bare>[0-9][A-Za-z0-9+/_.=-]*)
  | (?P<plus>\+)
  | (?P<close>[\])])
  | (?P<line>\n)
  | (?P<other>[^\s\w])
""", re.VERBOSE | re.ASCII)
_STRINGS = {'"': re.compile(r'"(?:[^"\\\n]++|\\.)*+"'), "'": re.compile(r"'(?:[^'\\\n]++|\\.)*+'"),
            "`": re.compile(r"`[^`\n]*+`")}
_BOUND = re.compile(r"[:=]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BARE_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_KEY = re.compile(r"""["'\])\x20\t]*(?::|=(?!=))""")  # what follows a key
_LINE_END = re.compile(r"[\x20\t\r]*(?:\n|\Z)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _BOUND.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive a target name is: its heaviest word or pair of words."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


class Value:
    """A literal, or the join of several: what its weight needs, and its pieces."""

    __slots__ = ("counts", "size", "head", "tail", "url", "span", "pieces", "weight")

    def __init__(self, counts: Counter, size: int, head: str, tail: str, url: bool,
                 span: tuple[int, int] | None = None, pieces: tuple[Value, ...] = ()):
        self.counts, self.size, self.head, self.tail, self.url = counts, size, head, tail, url
        self.span, self.pieces = span, pieces
        self.weight = self._weight()

    def _weight(self) -> float:
        if self.size < 6 or " " in self.counts or self.url:
            return 0.0
        shares = [c / self.size for c in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        chars = "".join(self.counts)
        classes = sum(bool(re.search(p, chars))
                      for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, entropy / 4 * 0.7 + min(self.size, 32) / 32 * 0.2 + (classes - 1) * 0.1)


def literal(value: str, span: tuple[int, int] | None = None) -> Value:
    return Value(Counter(value), len(value), value[:2], value[-2:], "://" in value, span)


def join(values: list[Value]) -> Value:
    if len(values) == 1:
        return values[0]
    counts, size, head, tail, url = Counter(), 0, "", "", False
    for v in values:
        counts.update(v.counts)
        url = url or v.url or "://" in tail + v.head
        size, head, tail = size + v.size, (head + v.head)[:2], (tail + v.tail)[-2:]
    return Value(counts, size, head, tail, url, None, tuple(values))


def literal_weight(value: str) -> float:
    """0 to 1: long, varied, mixed literals look like secrets; words, paths,
    placeholders and repeated characters do not."""
    return literal(value).weight


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each token. A quote that no other closes on its line
    is a ``close`` (a backtick an ``other``); then the same holds for all quotes
    of its kind behind it on that line, as an open string reads the rest of the
    line the same way from any of them. So no line is read twice."""
    at, open_until = 0, {}
    while m := _LEX.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            quote = m[0]
            kind = "other" if quote == "`" else "close"
            if open_until.get(quote, 0) <= start:
                string = _STRINGS[quote].match(text, start)
                if string:
                    kind, at = "string", string.end()
                else:
                    line_end = text.find("\n", start)
                    open_until[quote] = len(text) if line_end < 0 else line_end
        yield kind, start, at


def pairs(text: str) -> dict[str, list[list[tuple[tuple[int, int] | None, str | None]]]]:
    """What each name is bound to: a list of operands (several if joined by
    ``+``), each a literal's span, a name, or a bare word that may be either."""
    bound: dict[str, list[list[tuple[tuple[int, int] | None, str | None]]]] = defaultdict(list)
    target, state, last = None, 0, None  # state 0: no target; 1: after a bind; 2: after a value
    wait, carried, operands = "", False, []  # carried: a line has ended in state 1 or 2
    run_end = 0  # of the last run of bare characters
    for kind, start, end in tokens(text):
        value = text[start:end]
        if kind == "line":
            carried, last = state > 0, None
        elif kind == "bind":
            if value in ("=", ":", ":=", "=>") and last is not None:
                target, state, wait = last, 1, value
                bound[target].append(operands := [])
            else:
                target, state = None, 0
            last, carried = None, False
        elif kind in ("string", "bare", "name"):
            bare = None
            if kind != "string":  # from anywhere within a run it ends at the same place
                if start >= run_end:
                    run_end = _BARE_VALUE.match(text, start).end()
                bare = (start, run_end)
            plain = True  # a bare word may be a literal
            if carried:
                alone = bare is not None and _LINE_END.match(text, bare[1]) is not None
                plain = wait == "+" or alone
                if state == 2 or _KEY.match(text, end) or not (
                        plain or kind == "string" or kind == "name" and wait != ":"):
                    target, state = None, 0
                carried = False
            if kind == "string":
                found = (start + 1, end - 1)
            elif state == 1 and bare and plain and (
                    kind == "bare" or bare[1] > end or any(c.isdigit() for c in value)):
                found = bare
            else:
                found = None
            if state == 1 and target is not None:
                lit = found if found is not None and found[1] > found[0] else None
                name = value if kind == "name" else None
                if lit is not None or name is not None:
                    operands.append((lit, name))
                state = 2
            last = value if kind == "name" else value[1:-1] if kind == "string" else None
            if last is not None and not re.fullmatch(r"[A-Za-z_][\w.:>-]*", last, re.ASCII):
                last = None
        elif kind == "plus":
            state, wait = (1, "+") if state == 2 else (0, "")
        elif kind == "other":
            if carried and state == 2:
                target, state, carried = None, 0, False
            if value not in "$<{([":
                state, last = (0, None) if value in ",;" else (state, last)
                target = None if value in ",;" else target
    return bound


class Joins:
    """The values of literals and concatenations, each worked out once."""

    def __init__(self, text: str, bound: dict):
        self.text, self.bound = text, bound
        self.literals: dict[tuple[int, int], Value] = {}
        self.names: dict[str, tuple[list[Value], dict[int, list]]] = {}
        self.done: dict[int, list[Value]] = {}  # by a concatenation's id; empty while at work

    def literal(self, span: tuple[int, int]) -> Value:
        if span not in self.literals:
            self.literals[span] = literal(self.text[span[0]:span[1]], span)
        return self.literals[span]

    def _stands_for(self, name: str) -> tuple[list[Value], dict[int, list]]:
        """The literals and the concatenations of a name, also through names."""
        if name not in self.names:
            seen, todo, literals, chains = {name}, [name], [], {}
            while todo:
                for operands in self.bound.get(todo.pop(), ()):
                    if len(operands) > 1:
                        chains[id(operands)] = operands
                        continue
                    for lit, other in operands:
                        if lit is not None:
                            literals.append(self.literal(lit))
                        if other is not None and other not in seen:
                            seen.add(other)
                            todo.append(other)
            self.names[name] = literals, chains
        return self.names[name]

    def _needs(self, operands: list) -> Iterator[list]:
        return (chain for _, name in operands if name is not None
                for chain in self._stands_for(name)[1].values())

    def of(self, operands: list) -> list[Value]:
        """The joined values, the strongest first; a concatenation within a
        cycle is joined without what is still at work."""
        if id(operands) not in self.done:
            self.done[id(operands)] = []
            stack = [(operands, self._needs(operands))]
            while stack:
                at, needs = stack[-1]
                need = next((c for c in needs if id(c) not in self.done), None)
                if need is not None:
                    self.done[id(need)] = []
                    stack.append((need, self._needs(need)))
                else:
                    self.done[id(at)] = self._join(at)
                    stack.pop()
        return self.done[id(operands)]

    def _join(self, operands: list) -> list[Value]:
        best, others = [], []
        for lit, name in operands:
            if name is None:
                best.append(self.literal(lit))
                continue
            literals, chains = self._stands_for(name)
            values = literals + [self.done[c][0] for c in chains if self.done.get(c)]
            if values:
                top = max(values, key=lambda v: (v.weight, v.size))
                if id(operands) not in chains:  # not x = x + ...
                    others += [(len(best), v) for v in values if v is not top]
                best.append(top)
        if not best:
            return []
        return [join(best), *(join([*best[:k], v, *best[k + 1:]]) for k, v in others)]


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    if not _BOUND.search(text):
        return []
    bound = pairs(text)
    joins, out, told = Joins(text, bound), set(), set()

    def tell(value: Value) -> None:
        todo = [value]
        while todo:
            v = todo.pop()
            if id(v) not in told:
                told.add(id(v))
                todo += v.pieces
                if v.span is not None:
                    out.add((*v.span, "lexed"))

    for name in bound:
        weight = name_weight(name)
        if weight == 0.0:
            continue
        seen, todo = {name}, [name]
        while todo:  # constants through names, cycles included
            for operands in bound.get(todo.pop(), ()):
                values = [joins.literal(lit) for lit, _ in operands if lit is not None]
                if len(operands) > 1:
                    values += joins.of(operands)
                for value in values:
                    if weight + value.weight >= THRESHOLD:
                        tell(value)
                for _, other in operands:
                    if other is not None and other not in seen:
                        seen.add(other)
                        todo.append(other)
    return list(out)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind, then end."""
    if not text:
        return []
    return sorted(base_spans(text) + lexed_spans(text), key=lambda s: (s[0], RANK[s[2]], s[1]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(t.as_py())]
                 for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(span))],
                              ["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of (kind, start, end).

    >>> # a null or empty text: an empty array; repeated rows: one result each;
    >>> # an empty table: no rows; other columns are not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        _rows, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    from pyspark.sql import functions as F

    def text(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), count("lexed").alias("n_lexed"),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256)
        .alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"))
