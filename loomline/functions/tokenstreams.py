"""Counts of a whole file at once for languages whose comments can't be told by one expression.

JavaScript and TypeScript: whether a slash opens a regular expression depends on what stands before it.
One search finds comments, strings, templates and slashes; at a slash the code since the last of these
is looked at from its end, for the last character that says whether an operand may follow.

The Python family: whether a string is documentation depends on the statement it stands in.  One
search finds comments and strings; brackets, the last code of each line and the lines that begin a
statement are then told for all lines at once by arrays over the file's bytes, and only strings with
nothing before them in their line are looked at one by one: is the line the first statement of the file,
at its margin, or the one after a whole header, further in?
"""

from __future__ import annotations

import re

import numpy as np

from .bytesets import WIDE_SPACE
from .linescan import _OPERAND_WORDS, IDENTIFIER
from .statements import HEADERS, margin
from .wholefile import ink_lines, physical_line_count

# --- JavaScript and TypeScript

_JS_STRINGS = rb"\"(?:[^\"\\\n]|\\[^\n])*+(?P<double>\")?|'(?:[^'\\\n]|\\[^\n])*+(?P<single>')?"
_JS = rb"(?P<comment>//[^\n]*+|/\*(?:.*?\*/|.*))|(?P<slash>/)|(?P<string>" + _JS_STRINGS + rb")|(?P<template>`)"
_JS_CODE = re.compile(_JS, re.S)
_JS_HOLE = re.compile(_JS + rb"|(?P<brace>[{}])", re.S)
_JS_TEXT = re.compile(rb"(?:[^`$\\]|\\.|\$(?!\{)|\\\Z)*+(`|\$\{)?", re.S)
_JS_PATTERN = re.compile(rb"(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]?|[^\\/\[\n])*+(/)?")
_REST = re.compile(rb"[^\n]*+")
_NAME_END = re.compile(rb"[A-Za-z0-9_$]+\Z")
#: bytes that leave open what may follow
_NEUTRAL = bytes(sorted(set(range(256)) - set(b".+-=:,;([!?*&|)]{}/'\"`_$0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def _operand_after(code: bytes, before: bool) -> bool:
    """Whether an operand may follow ``code``, which has no string, comment, slash or template."""
    code = code.rstrip(_NEUTRAL)
    if not code:
        return before
    last = code[-1:]
    if last in b")]}":
        return False
    if (word := _NAME_END.search(code[-64:])) is None:
        return True
    return word[0].lstrip(b"0123456789") in _OPERAND_WORDS


class JavaScript:
    def comments(self, data: bytes) -> list[tuple[int, int]]:
        """Where comments begin and end."""
        out = []
        pos = at = 0  # where to search on, and the end of what ``operand`` knows of
        operand = True
        holes: list[int] = []  # braces that are open in each template's hole
        search = _JS_CODE.search
        while m := search(data, pos):
            kind, start, pos = m.lastgroup, m.start(), m.end()
            if kind == "comment":
                operand = _operand_after(data[at:start], operand)
                out.append((start, pos))
            elif kind == "slash":
                if _operand_after(data[at:start], operand):
                    body = _JS_PATTERN.match(data, pos)
                    operand = body[1] is None
                    pos = body.end() if body[1] else _REST.match(data, pos).end()
                else:
                    operand = True
            elif kind == "brace":
                operand = data[start] == 123
                holes[-1] += 1 if operand else -1
                if holes[-1] == 0:
                    holes.pop()
                    pos, operand = self._text(data, pos, holes)
            elif kind == "template":
                pos, operand = self._text(data, pos, holes)
            else:  # a string; one that its line ends leaves open what it found
                closed = m["double"] or m["single"]
                operand = False if closed else _operand_after(data[at:start], operand)
            search = (_JS_HOLE if holes else _JS_CODE).search
            at = pos
        return out

    def _text(self, data: bytes, pos: int, holes: list[int]) -> tuple[int, bool]:
        """Where the text of a template ends that begins at ``pos``, and whether an operand may follow."""
        m = _JS_TEXT.match(data, pos)
        if m[1] == b"${":
            holes.append(1)
            return m.end(), True
        return m.end() if m[1] else len(data), False

    def counts(self, data: bytes) -> tuple[int, int, int]:
        """Code, comment and blank lines."""
        pieces, at = [], 0
        for a, b in self.comments(data):
            pieces += [data[at:a], b"\n" * data.count(b"\n", a, b)]
            at = b
        lines, inked = physical_line_count(data), ink_lines(data)
        n = ink_lines(b"".join([*pieces, data[at:]])) if at else inked
        return n, inked - n, lines - inked


# --- the Python family

_TRIPLE = rb"(?P<triple>\"\"\"(?:[^\"\\]|\\(?:(?=\r?\n)|.|\Z)|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\(?:(?=\r?\n)|.|\Z)|'(?!''))*+(?:''')?)"
_LINE = rb"\"(?:[^\"\\\n]|\\\r?\n|\\[^\n]|\\\Z)*+\"?|'(?:[^'\\\n]|\\\r?\n|\\[^\n]|\\\Z)*+'?"
_PYTHON = re.compile(rb"#[^\n]*+|(?:(?<![" + IDENTIFIER + rb"])(?P<prefix>[rRuUbBfF]{1,2})(?=[\"']))?(?:" + _TRIPLE + rb"|" + _LINE + rb")", re.S)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FAR = 1 << 32
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"([{")] = 1
_DEPTH[list(b")]}")] = -1


class _Lines:
    """What the lines of files are, told from where comments and strings stand.

    The files stand one after another in ``data``, each but the last ending with a line feed.
    """

    def __init__(self, data: bytes, tokens: list[tuple[int, int, bool]], files: np.ndarray):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        feeds = np.flatnonzero(raw == 10)
        self.starts = np.append(0, feeds + 1)
        if len(self.starts) > 1 and self.starts[-1] == len(data):
            self.starts = self.starts[:-1]
        self.n = len(self.starts)
        self.stops = np.append(feeds, len(data))[: self.n]
        spans = np.array(tokens, np.int64).reshape(-1, 3)
        begin, end, string = spans[:, 0], spans[:, 1], spans[:, 2].astype(bool)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[begin] += 1
        np.subtract.at(edge, end, 1)
        outside = np.cumsum(edge[:-1], dtype=np.int8) == 0
        seen = raw if data.isascii() else np.frombuffer(WIDE_SPACE.sub(lambda m: b" " * len(m[0]), data), np.uint8)
        ink = ~_SPACE[seen]
        places = np.flatnonzero(ink)
        first = np.searchsorted(places, self.starts)
        self.first = np.append(places, len(data))[first]  # the first ink of a line, if it has any
        self.text = self.first < self.stops
        self.code = self._any(ink & outside)
        code = np.flatnonzero(~_SPACE[raw] & outside)
        last = np.searchsorted(code, self.stops)
        place = np.append(-1, code)[last]  # the last code before the line's end
        opened = np.append(-1, begin[string])[np.searchsorted(begin[string], self.stops)]  # and the last string
        own = (place >= self.starts) & (place > opened)
        self.tail = np.where(own, raw[np.maximum(place, 0)] if len(raw) else 0, 0)
        self.code_places, self.string_begin, self.string_end = code, begin[string], end[string]
        step = (_DEPTH[raw] * outside).astype(np.int64)
        step[files[1:] - 1] = -_FAR  # below all that was: brackets don't stay open from file to file
        depth = np.cumsum(step)
        depth -= np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else 0
        self.depth = np.append(0, depth)[self.stops]
        k = np.searchsorted(self.string_begin, self.stops, "right") - 1
        self.open = (k >= 0) & (np.append(self.string_end, 0)[k] > self.stops)  # a string goes over the line's end
        self.goes_on = (self.depth > 0) | (~self.open & (self.tail == 92))
        closed = ~self.open & ~self.goes_on
        before = np.append(True, closed[:-1])
        self.first_lines = np.searchsorted(self.starts, files)
        before[self.first_lines] = True
        self.file = np.searchsorted(files, self.starts, "right")
        self.begins = self.text & before & (np.append(raw, 0)[self.first] != 35)
        self.begin_lines, self.closed_lines = np.flatnonzero(self.begins), np.flatnonzero(closed)

    def _any(self, flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[self.stops] > total[self.starts]

    def margin(self, line: int) -> int:
        return margin(self.data[self.starts[line] : self.stops[line]])

    def may_document(self, line: int) -> bool:
        """Whether a string that opens a statement in this line is documentation."""
        if not self.begins[line]:
            return False
        k = int(np.searchsorted(self.begin_lines, line))
        if k == 0 or self.file[self.begin_lines[k - 1]] != self.file[line]:
            return self.margin(line) == 0
        header = int(self.begin_lines[k - 1])
        end = int(self.closed_lines[np.searchsorted(self.closed_lines, header)])
        whole = self.tail[end] == 58 and self.data.startswith(HEADERS, int(self.first[header]))
        return bool(whole) and self.margin(line) > self.margin(header)

    def documents(self, prefixes: list[bytes | None]) -> np.ndarray:
        """Which strings are documentation."""
        a, b = self.string_begin, self.string_end
        self.line = np.searchsorted(self.starts, a, "right") - 1
        self.last_line = np.searchsorted(self.starts, b - 1, "right") - 1
        code_before = np.searchsorted(self.code_places, a)
        bare = code_before == np.searchsorted(self.code_places, self.starts[self.line])
        earlier = np.append(0, b[:-1])
        opens = np.flatnonzero(bare & (earlier <= self.starts[self.line]) & self.begins[self.line])
        # further strings of a line, with nothing in between
        joined = np.zeros(len(a), bool)
        joined[1:] = (self.line[1:] == self.last_line[:-1]) & (code_before[1:] == np.searchsorted(self.code_places, b[:-1]))
        out = np.zeros(len(a), bool)
        for k in opens.tolist():
            if self.may_document(int(self.line[k])):
                while not (prefixes[k] and set(prefixes[k].lower()) & set(b"bf")):
                    out[k] = True
                    k += 1
                    if k == len(a) or not joined[k]:
                        break
        return out


#: bytes of files that are told at once
TOGETHER = 2 << 20


class Python:
    def counts(self, data: bytes) -> tuple[int, int, int]:
        """Code, comment and blank lines."""
        return self.counts_of([data])[0]

    def counts_of(self, contents: list[bytes]) -> list[tuple[int, int, int]]:
        """``counts`` of many files; small ones share the work that is done for all lines at once."""
        out = [(0, 0, 0)] * len(contents)
        held: list[int] = []
        size = 0
        for k, data in enumerate(contents):
            if data:
                held.append(k)
                size += len(data)
            if held and (size >= TOGETHER or k == len(contents) - 1):
                for i, c in zip(held, self._told([contents[i] for i in held]), strict=True):
                    out[i] = c
                held, size = [], 0
        return out

    def _told(self, contents: list[bytes]) -> list[tuple[int, int, int]]:
        tokens, prefixes, files, parts, at = [], [], [], [], 0
        for data in contents:
            files.append(at)
            for m in _PYTHON.finditer(data):
                a, b = m.span()
                string = data[a] != 35
                tokens.append((at + a, at + b, string))
                if string:
                    prefixes.append(m["prefix"])
            parts.append(data)
            if not data.endswith(b"\n"):
                parts.append(b"\n")
            at += len(data) + (not data.endswith(b"\n"))
        lines = _Lines(b"".join(parts), tokens, np.array(files))
        code = lines.code
        if prefixes:
            plain = ~lines.documents(prefixes)
            inside = np.zeros(lines.n + 1, np.int64)
            np.add.at(inside, lines.line[plain], 1)
            np.subtract.at(inside, lines.last_line[plain] + 1, 1)
            code = code | (np.cumsum(inside[:-1]) > 0)
        total = np.diff(np.append(lines.first_lines, lines.n))
        text = np.add.reduceat(lines.text.astype(np.int64), lines.first_lines)
        n = np.add.reduceat((code & lines.text).astype(np.int64), lines.first_lines)
        return list(zip(n.tolist(), (text - n).tolist(), (total - text).tolist(), strict=True))
