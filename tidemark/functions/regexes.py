"""Matches of regular expressions as rows: one Arrow table function looks at each text once, for all rules of a language.

A rule says what to look for, what may follow, and which body belongs to a match. The rows carry groups, places, and stretches of
bounded length; no text leaves the function, so shuffles after it don't grow with texts. Newlines are counted once a text,
and the braces of a text are matched once, whatever the number of matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals and comments of each language, longest first; a lone quote that opens none of them ends the scan.
PIECES = {
    "js": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|/\*|["\'`]',
    "go": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|`[^`]*`|//[^\n]*|/\*.*?\*/|/\*|["`]',
    "jvm": r'"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|//[^\n]*|/\*.*?\*/|/\*|"',
    "rust": r'b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]*?|[^\\\'\n])\'|//[^\n]*|/\*|"',
}
COMMENT_ENDS = re.compile(r"/\*|\*/")


@dataclass(frozen=True)
class Rule:
    """What to look for in a text.

    ``then`` is searched in the ``window`` characters after a match. ``body`` asks for the braces that open after the match's
    "start" or "end", or after the start of what ``then`` found. ``inside`` are patterns whose first group is taken from the lines
    of the body. ``before`` characters ahead of the match come along. ``each`` turns the body's lines into
    rows of groups, of the rule "name.each", whose ``inner`` has the groups of the match.
    """

    pattern: str
    then: str | None = None
    window: int = 0
    before: int = 0
    body: str | None = None
    inside: tuple[str, ...] = ()
    each: Callable[[list[str]], Iterator[tuple[int, list[str]]]] | None = None


class Braces:
    """The braces of a text outside literals and comments, matched in one pass when first asked for."""

    def __init__(self, text: str, language: str):
        self.text, self.nested = text, language == "rust"
        self.pattern = re.compile(PIECES[language] + "|[{}]", re.S)
        self.starts: list[int] | None = None

    def piece(self, at: int) -> tuple[str, int, int] | None:
        """The next brace, literal or comment at or after an offset: "{", "}", "" for others, "!" where the scan must end."""
        if not (m := self.pattern.search(self.text, at)):
            return None
        piece, end = m[0], m.end()
        if piece == "/*" and self.nested:
            level = 1
            while level and (c := COMMENT_ENDS.search(self.text, end)):
                level, end = level + (1 if c[0] == "/*" else -1), c.end()
            return ("" if not level else "!"), m.start(), end
        return (piece if piece in "{}" else "!" if piece in ('"', "'", "`", "/*") else ""), m.start(), end

    def match(self) -> None:
        """For every piece of the text from its start: the brace that closes what is open after it, and the next that opens."""
        kinds, self.starts, self.ends, at = [], [], [], 0
        while p := self.piece(at):
            kinds.append(p[0])
            self.starts.append(p[1])
            self.ends.append(p[2])
            at = p[2]
        n = len(kinds)
        self.closer, self.opener = [-1] * n, [-1] * n
        # From the end: ``closer`` of a piece is the "}" that closes the innermost braces open after it.
        closes: list[int] = []
        opens = -1
        for i in range(n - 1, -1, -1):
            self.closer[i], self.opener[i] = (closes[-1] if closes else -1), opens
            if kinds[i] == "}":
                closes.append(i)
            elif kinds[i] == "{":
                if closes:
                    closes.pop()
                opens = i
            elif kinds[i] == "!":
                closes, opens = [], -1
        self.kinds, self.first = kinds, opens

    def end(self, start: int) -> int | None:
        """Offset of the brace that closes the next balanced braces after an offset; none where they never close."""
        if self.starts is None:
            self.match()
        at, depth = start, 0
        while True:
            i = bisect_left(self.starts, at)  # pieces before i start before ``at``
            if not (i and self.ends[i - 1] > at):  # ``at`` lies between pieces: from here on the pieces are those of the whole text
                return self.closing(i, depth)
            p = self.piece(at)  # inside a literal or a comment, which a scan from here takes otherwise
            if not p or p[0] == "!":
                return None
            if p[0] == "{":
                depth += 1
            elif p[0] == "}" and depth:
                depth -= 1
                if not depth:
                    return p[1]
            at = p[2]

    def closing(self, i: int, depth: int) -> int | None:
        """Offset of the brace where ``depth`` open braces are closed, reading from piece ``i`` on; of the next braces if 0."""
        n = len(self.kinds)
        if i >= n:
            return None
        before = i - 1
        if not depth:
            j = self.opener[before] if before >= 0 else self.first
            return None if j < 0 or self.closer[j] < 0 else self.starts[self.closer[j]]
        j = before
        while depth:
            if j < 0:
                return None
            j = self.closer[j]
            if j < 0:
                return None
            depth -= 1
        return self.starts[j]


def brace_range(text: str, start: int, language: str) -> tuple[int, int] | None:
    """Lines from ``start`` (an offset) to the end of the next balanced braces; none where they never close."""
    end = Braces(text, language).end(start)
    return None if end is None else (text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1)


FOUND = pa.schema([
    ("rule", pa.string()), ("line", pa.int32()), ("start", pa.int64()), ("g", pa.list_(pa.string())), ("t", pa.list_(pa.string())), ("gap", pa.int32()), ("between", pa.string()), ("ahead", pa.string()),
    ("lo", pa.int32()), ("hi", pa.int32()), ("inner", pa.list_(pa.string())),
])
FOUND_SQL = "rule string, line int, start long, g array<string>, t array<string>, gap int, between string, ahead string, lo int, hi int, inner array<string>"


def looked(text: str, rules: dict[str, tuple], language: str | None) -> Iterator[tuple]:
    """Rows of FOUND for one text. ``rules``: name to rule and its compiled patterns."""
    newlines = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(newlines, at) + 1
    braces = Braces(text, language) if language else None
    groups = lambda m: [m[0], *[x or "" for x in m.groups()]]
    for name, (rule, pattern, then, inside) in rules.items():
        for m in pattern.finditer(text):
            start, end = m.span()
            follows = gap = between = None
            if then and (f := then.search(text[end : end + rule.window])):
                follows, gap, between = groups(f), f.start(), text[end : end + f.start()]
            at = {"start": start, "end": end, "then": None if gap is None else end + gap}.get(rule.body or "")
            close = braces.end(at) if braces and at is not None else None
            lo, hi = (None, None) if close is None else (line(at), line(close))
            inner = None
            if lo is not None and (inside or rule.each):
                first = newlines[lo - 2] + 1 if lo > 1 else 0
                last = newlines[hi - 1] if hi - 1 < len(newlines) else len(text)
                body = text[first:last]
                inner = [x[1] if (x := p.search(body)) else "" for p in inside]
                if rule.each:
                    for i, g in rule.each(body.split("\n")):
                        yield f"{name}.each", lo + i, start, g, follows, gap, None, None, None, None, groups(m)
            yield name, line(start), start, groups(m), follows, gap, between, text[max(0, start - rule.before) : start] if rule.before else None, lo, hi, inner


def find(files: DataFrame, rules: dict[str, Rule], language: str | None = None) -> DataFrame:
    """Every match of every rule: repo, rel, rule, line and start of the match, its groups ``g`` (g[0]: all of it).

    Also ``t``, ``gap`` and ``between`` of what follows, the text ``ahead``, lines ``lo`` and ``hi`` of the body, and ``inner``. Groups without
    a part in a match are ''. Null texts have no matches.
    """
    made = lambda r: (r, re.compile(r.pattern), re.compile(r.then) if r.then else None, [re.compile(p) for p in r.inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {name: made(r) for name, r in rules.items()}
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [(repo, rel, *row) for repo, rel, text in zip(*(part.column(c).to_pylist() for c in ("repo", "rel", "text")), strict=True) for row in looked(text, compiled, language)]
                columns = list(zip(*rows, strict=True)) or [()] * (len(FOUND) + 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *FOUND.types], strict=True)], ["repo", "rel", *FOUND.names])

    return files.where("text is not null").select("repo", "rel", "text").mapInArrow(run, f"repo string, rel string, {FOUND_SQL}")


def group(n: int, of: str = "g") -> Column:
    """Group ``n`` of a match (0: all of it); null where the match has no such group."""
    return F.get(of, F.lit(n))

