"""Secret scans by assignment-aware lexing.

`secret_spans` finds three base kinds by pattern (assignments to sensitive names, access keys, long hex runs) and a
fourth, `literal`, by lexing: statements of source and configuration syntax become name-literal pairs, constants are
propagated from name to name to a fixed point, and each literal is scored by the sensitive names that it reaches. What
stands in brackets, or behind an operator, is read once and shared by all statements that hold it, so the time grows with
the text however deeply statements are nested.

Null and empty texts have no spans; a text of any length is read whole; repeated rows give repeated results; an
empty table gives an empty one; further columns of the input are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import gc
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import carried, map_texts, table, with_carried

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.6

_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in _WORDS)
ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")

#: How sensitive a target name is, by the parts it is made of.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "key": 0.5,
}
#: A text without any of these has no sensitive name.
_SENSITIVE = re.compile("(?i)pass|pwd|secret|token|key|credential|auth|bearer|signature")
_PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|change_?me|example.*|sample.*|dummy.*|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
#: Placeholders that may go on as they like.
_OPEN_ENDED = re.compile(r"(?i)example|sample|dummy|your")
#: What the lexer tells apart; all other characters separate. A quote after a letter opens no string (don't).
_TOKEN = re.compile(
    r"""(?P<long>\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3})
    |(?P<text>"(?:\\.|[^"\\\n])*"|(?:(?<![A-Za-z0-9])|(?<=\b[bBfFrRuU]))'(?:\\.|[^'\\\n])*'|`[^`\n]*`)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.\-]+[A-Za-z0-9_]+)*)
    |(?P<op>[=!<>]=|:=|=>|\+=|[=:\[\]])""",
    re.X | re.S,
)
_ASSIGNS = {"=", ":", ":=", "=>", "+="}
#: A value without quotes; an equals sign only at its end.
_BARE = re.compile(r"""(?:[^\s"'`,;(){}\[\]#<>=]|=(?![^\s=,;"')\]}]))+""")
_NAME = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_]*(?:[.\-]+[A-Za-z0-9_]+)*)\}?\Z")
_SPACE, _SPACE_LINES = re.compile(r"(?:[ \t]|\\\r?\n)*"), re.compile(r"(?:\s|\\)*")
#: What may stand between two operands of one value.
_JOIN = re.compile(r"\+|\|\||\?\?|or\b|[.%&](?!\w)")
_SHELL = re.compile(r"\$\{?([A-Za-z_]\w*)\}?")
_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")
_BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds; leftmost, not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def name_score(name: str) -> float:
    """0 to 1: the weight of the most sensitive part, or pair of parts, of a name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:]))]), default=0.0)


def value_score(value: str) -> float:
    """0 to 1: long literals of many different characters look like secrets; placeholders never do."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return 0.0
    if len(value) > 1 << 12:
        codes, n = np.unique(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        counts = dict(zip(map(chr, codes.tolist()), n.tolist()))
    else:
        counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    mixed = any(c.isdigit() for c in counts) + any(c.isalpha() for c in counts) + (len(value) >= 12)
    return min(1.0, bits / 3.0) * (0.4 + 0.2 * mixed)


def value_scores(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """value_score of each span. Spans that end at one place, as nested values do, are counted in one pass from there."""
    ends: dict[int, list[int]] = defaultdict(list)
    for start, end in spans:
        ends[end].append(start)
    out = {}
    for end, starts in ends.items():
        if len(starts) == 1:
            out[starts[0], end] = value_score(text[starts[0] : end])
            continue
        counts, at, total, digit, letter = Counter(), end, 0.0, False, False
        for start in sorted(starts, reverse=True):
            for c in text[start:at]:
                n = counts[c]
                counts[c] = n + 1
                total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
                digit, letter = digit or c.isdigit(), letter or c.isalpha()
            at, size = start, end - start
            if size < 6 or _placeholder(text, start, end):
                out[start, end] = 0.0
            else:
                out[start, end] = min(1.0, (math.log2(size) - total / size) / 3.0) * (0.4 + 0.2 * (digit + letter + (size >= 12)))
    return out


def _placeholder(text: str, start: int, end: int) -> bool:
    if end - start > 256 and _OPEN_ENDED.match(text, start):
        return text.find("\n", start, end) in (-1, end - 1)
    return bool(_PLACEHOLDER.match(text, start, end))


class Value:
    """The literals (start, end) of a value or a part of one, the names that it mentions and the parts that it shares.

    index: the statement that read it first, before which a mentioned name's value is looked for."""

    __slots__ = ("index", "literals", "mentions", "parts", "end", "reached")

    def __init__(self, index: int):
        self.index, self.literals, self.mentions, self.parts = index, [], [], []
        self.end, self.reached = None, 0.0


@dataclass(slots=True)
class Statement:
    name: str
    value: Value


class Lexer:
    """Name-literal pairs of source and configuration syntax: assignments, keyword arguments, subscripts, JSON, YAML with
    block texts, INI, shell, XML elements and attributes, and name/value pairs of entries."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, *m.span()) for m in _TOKEN.finditer(text)]
        self.strings = {start: end for kind, start, end in self.tokens if kind in ("text", "long")}
        self.brackets: dict[int, Value] = {}
        self.operands: dict[int, Value] = {}
        self.bare, self.digits, self.lines = (0, 0), None, None

    def inside(self, start: int, end: int) -> tuple[int, int]:
        """A string's content."""
        quotes = 3 if self.text.startswith(('"""', "'''"), start) and end - start >= 6 else 1
        return start + quotes, end - quotes

    def statements(self) -> list[Statement]:
        text, tokens, out = self.text, self.tokens, []
        for i, (kind, start, end) in enumerate(tokens):
            if kind == "op" or kind == "long":
                continue
            name, j = text[slice(*self.inside(start, end))] if kind == "text" else text[start:end], i + 1
            # subscripts belong to the name
            while j + 2 < len(tokens) and text[tokens[j][1] : tokens[j][2]] == "[" and tokens[j + 1][0] in ("text", "name") and text[tokens[j + 2][1] : tokens[j + 2][2]] == "]":
                own = tokens[j + 1]
                name += "." + (text[slice(*self.inside(*own[1:]))] if own[0] == "text" else text[own[1] : own[2]])
                end, j = tokens[j + 2][2], j + 3
            if j >= len(tokens) or tokens[j][0] != "op" or text[tokens[j][1] : tokens[j][2]] not in _ASSIGNS or text[end : tokens[j][1]].strip(" \t"):
                continue
            op, at = text[tokens[j][1] : tokens[j][2]], tokens[j][2]
            if op == ":":
                if text[at : at + 1] in (":", "/"):
                    continue
                # name: type = value
                if j + 2 < len(tokens) and tokens[j + 1][0] == "name" and text[tokens[j + 2][1] : tokens[j + 2][2]] == "=" and not text[tokens[j + 1][2] : tokens[j + 2][1]].strip(" \t"):
                    at = tokens[j + 2][2]
            own = Statement(name, self.value(at, start, op == ":", len(out)))
            if op == "+=":
                own.value.mentions.append(name)
            # an entry's name and its value: {"name": "PASSWORD", "value": "..."}
            if name.lower() == "value" and out and out[-1].name.lower() in ("name", "key"):
                entry = [text[a:b] for a, b in out[-1].value.literals] or list(dict.fromkeys(out[-1].value.mentions))
                own.name = entry[0] if len(entry) == 1 else name
            out.append(own)
        for m in _ELEMENT.finditer(text) if "</" in text else ():
            value = m[2].strip()
            if value:
                at = m.start(2) + m[2].index(value)
                out.append(Statement(m[1], Value(len(out))))
                out[-1].value.literals.append((at, at + len(value)))
        return out

    def bare_end(self, at: int) -> int | None:
        """Where a value without quotes that begins here ends; the same for all places of a run."""
        if not self.bare[0] <= at < self.bare[1]:
            m = _BARE.match(self.text, at)
            if not m:
                return None
            self.bare = m.span()
        return self.bare[1]

    def has_digit(self, at: int, end: int) -> bool:
        if end - at <= 256:
            return any(c.isdigit() for c in self.text[at:end])
        if self.digits is None:
            self.digits = [k for k, c in enumerate(self.text) if c.isdigit()]
        k = bisect_left(self.digits, at)
        return k < len(self.digits) and self.digits[k] < end

    def value(self, at: int, target: int, block: bool, index: int) -> Value:
        """The value that begins at a place; target: where its statement begins. Each bracket is a part of its own, and so
        is what follows an operator outside of brackets; parts that were read before are taken as they are."""
        text, more = self.text, True
        out = now = Value(index)
        open_: list[tuple[int, Value]] = []  # brackets that are being read, and what they stand in
        at = _SPACE.match(text, at).end()
        if block and (m := _BLOCK.match(text, at)):
            out.literals += self.block(m.end(), target)
            return out
        while at < len(text):
            if (at in self.strings) or (text[at] in "bBfFrRuU" and at + 1 in self.strings and text[at + 1] != "`"):
                start = at if at in self.strings else at + 1
                end = self.strings[start]
                now.literals.append(self.inside(start, end))
                now.mentions += set(_VARIABLE.findall(text, start, end))
                at, more = end, False
            elif text[at] == "(":
                known = self.brackets.get(at)
                if known is not None:
                    now.parts.append(known)
                    if known.end is None:
                        break  # it was never closed
                    at, more = known.end, False
                else:
                    inner = self.brackets[at] = Value(index)
                    now.parts.append(inner)
                    open_.append((at, now))
                    now, at, more = inner, at + 1, True
            elif text[at] == ")" and open_:
                now.end, now, at, more = at + 1, open_.pop()[1], at + 1, False
            elif text[at] == "," and open_:
                at, more = at + 1, True
            elif m := (not more and _JOIN.match(text, at)):
                at, more = _SPACE_LINES.match(text, m.end()).end(), True
                if not open_:
                    known = self.operands.get(at)
                    now.parts.append(known or Value(index))
                    if known is not None:
                        break
                    now = self.operands[at] = now.parts[-1]
                continue
            elif not more:
                break
            elif text[at] == "$" and (m := _SHELL.match(text, at)):
                now.mentions.append(m[1])
                at, more = m.end(), False
            elif (end := self.bare_end(at)) is not None:
                start, at = at, end
                if text[at : at + 1] == "(":
                    continue  # a call: what it is given counts
                after = _SPACE.match(text, at).end()
                if open_ and text[after : after + 1] == "=":
                    break  # a keyword argument is a statement of its own
                if named := _NAME.match(text, start, end):
                    now.mentions.append(named[1])
                if self.has_digit(start, end):
                    now.literals.append((start, end))
                more = False
            else:
                break
            at = (_SPACE_LINES if open_ else _SPACE).match(text, at).end()
        return out

    def block(self, at: int, target: int) -> list[tuple[int, int]]:
        """The lines of a block text: those further in than the line of their name."""
        if self.lines is None:
            self.lines = Lines(self.text)
        line = self.text.rfind("\n", 0, target) + 1
        lead = self.text[line:target]
        return self.lines.deeper(at, len(lead) - len(lead.lstrip(" ")))


class Lines:
    """The lines of a text that hold something: where they and their content begin and end, how far they are in, and the
    next line that is less far in."""

    def __init__(self, text: str):
        self.start, self.begin, self.end, self.indent = [], [], [], []
        at = 0
        for line in text.split("\n"):
            own = line.strip()
            if own:
                self.start.append(at)
                self.begin.append(at + line.index(own))
                self.end.append(self.begin[-1] + len(own))
                self.indent.append(len(line) - len(line.lstrip(" ")))
            at += len(line) + 1
        self.out, open_ = [len(self.start)] * len(self.start), []
        for k, n in enumerate(self.indent):
            while open_ and self.indent[open_[-1]] > n:
                self.out[open_.pop()] = k
            open_.append(k)

    def deeper(self, at: int, indent: int) -> list[tuple[int, int]]:
        """From the first of the lines from a place on to the last one before a line that is no further in than indent."""
        first = k = bisect_left(self.start, at)
        while k < len(self.start) and self.indent[k] > indent:
            k = self.out[k]
        return [] if k == first else [(self.begin[first], self.end[k - 1])]


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of literals that reach a sensitive name, directly or through constants.

    A mentioned name stands for its last value before, or if it has none, for its later ones. Weights go from each
    statement to those that it mentions until nothing changes."""
    if not _SENSITIVE.search(text) or not (":" in text or "=" in text or "</" in text):
        return []
    # long texts make many small objects without cycles, which the collector would go through again and again
    pause = len(text) > 1 << 16 and gc.isenabled()
    if pause:
        gc.disable()
    try:
        return _reached_spans(text, Lexer(text).statements())
    finally:
        if pause:
            gc.enable()


def _reached_spans(text: str, statements: list[Statement]) -> list[tuple[int, int, int]]:
    places: dict[str, list[int]] = defaultdict(list)
    for k, own in enumerate(statements):
        places[own.name].append(k)
    names, held = defaultdict(float), []  # weights of names whose later values all count
    scores = {name: -name_score(name) for name in places}
    for weight, k in sorted(((scores[own.name], k) for k, own in enumerate(statements))):
        todo = [statements[k].value]  # the most sensitive first, so each part is reached once at its final weight
        while todo and weight < 0:
            part = todo.pop()
            if part.reached >= -weight:
                continue
            if not part.reached:
                held.append(part)
            part.reached = -weight
            todo += part.parts
            for name in set(part.mentions):
                own = places.get(name, ())
                before = bisect_left(own, part.index)
                if before:
                    todo.append(statements[own[before - 1]].value)
                elif names[name] < -weight:
                    names[name] = -weight
                    todo += [statements[j].value for j in own]
    score = value_scores(text, {span for part in held for span in part.literals})
    return sorted({(a, 3, b) for part in held for a, b in part.literals if part.reached * score[a, b] >= LEAST_SCORE})


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted([*base, *literal_spans(text)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        out += [text[at:start], mark] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, spans[, redacted]): the base spans and all spans as `kind:start:end` lists, for every row of docs.

    With a mark, the text with each secret replaced by it comes too (null texts stay null); with carry, these columns of docs."""
    kind = dict(docs.dtypes)[id_col]
    docs, more, kinds = with_carried(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, texts = [], batch.column(1).to_pylist()
        found = [all_spans(t or "") for t in texts]
        columns = [batch.column(0), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())]
        names = ["id", "base", "spans"]
        if mark is not None:
            names.append("redacted")
            columns.append(pa.array([t if not s else redacted(t, s, mark) for t, (_, s) in zip(texts, found)], pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [*names, *more])

    schema = f"id {kind}, base string, spans string" + ", redacted string" * (mark is not None) + kinds
    return carried(map_texts(docs, work, schema).withColumnRenamed("id", id_col), carry)


def count_of(kind: str, spans: Column) -> Column:
    return F.regexp_count(spans, F.lit(f"\\b{kind}:")).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", count_of("assign", F.col("base")).alias("n_assign"), count_of("access", F.col("base")).alias("n_access"),
        count_of("hex", F.col("base")).alias("n_hex"), F.sha2(F.col("base"), 256).alias("base_sha256"), "spans",
    )
