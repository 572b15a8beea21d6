"""Counts of a whole file at once.

One expression finds every comment and every string of a file, each from its opener to its end.  With
the comments taken out, a line that still has ink is code; one that had some is comment; the rest is
blank.  So the cost is one search over the file and not a call for each line.

``WholeFile`` serves languages whose comments and strings need no more than that (and a count of openers,
where comments nest); ``whole_file`` gives None for the others.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .bytesets import WIDE_SPACE
from .languages import Pair, Rules
from .linescan import RAW_CPP, RAW_RUST, bounded, compiled, digit_separator, events_of

#: features whose constructs are not regular
_BEYOND = {"py", "js", "cont"}
#: a line feed that the backslash before it takes away, and a backslash that ends a line
_JOIN = rb"\\\r?\n"
_LAST_BACKSLASH = re.compile(rb"\\(?=\r?\n)")
#: a character between apostrophes, without which an apostrophe names a lifetime
_RUST_CHARACTER = rb"'(?:\\x[^\n][^\n]|\\u\{[^}\n]*\}|\\[^xu\n]|[\x00-\x09\x0b-\x5b\x5d-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x80-\xff])'"


def ink_lines(data: bytes) -> int:
    """Lines that are more than white space."""
    if not data.isascii():
        data = WIDE_SPACE.sub(b" ", data)
    return sum(map(bool, map(bytes.strip, data.split(b"\n"))))


def physical_line_count(data: bytes) -> int:
    return data.count(b"\n") + (not data.endswith(b"\n") and data != b"")


class WholeFile:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.fold, self.joins = "fold" in rules.features, "splice" in rules.features
        rust = "rust" in rules.features
        parts: list[tuple[str, bytes]] = []
        literal = True  # whether every opener is plain characters
        self.openers: list[tuple[bytes, str]] = []
        for _, _, name, opener in events_of(rules):
            text = self._opener(name)
            whole = self._whole(name, opener)
            if rust and text == b"'":
                whole, literal = b"(?=" + _RUST_CHARACTER + b")" + whole, False
            parts.append((name, whole))
            self.openers.append((text, name))
            literal = literal and re.escape(text) == opener
        self.numbers = "rawCpp" in rules.features  # apostrophes may part digits
        if self.numbers:
            parts.insert(0, ("raw", RAW_CPP + rb'(?:.*?\)(?P=delimiter)"|.*)'))
        if "rawRust" in rules.features:
            parts.insert(0, ("raw", RAW_RUST + rb'(?:.*?"(?P=hashes)|.*)'))
        comments = tuple(text for text, name in self.openers if name[0] != "q")
        quotes = tuple(text for text, name in self.openers if name[0] == "q")
        # expressions that open with plain characters are searched for by these, which groups would hide;
        # what a match opens with then tells a comment, if no comment opens with a quote or the other way
        self.plain = literal and not self.fold and len(parts) == len(self.openers) and not any(a.startswith(b) or b.startswith(a) for a in comments for b in quotes)
        self.comments = comments
        every = b"|".join(x if self.plain else b"(?P<%s>%s)" % (n.encode(), x) for n, x in parts) or rb"(?!)"
        self.any = re.compile(b"(" + every + b")" if self.plain else every, re.S | re.M | (re.I if self.fold else 0))
        nested = [re.escape(p.open) for p in rules.blocks if p.has("n")]
        self.nested = re.compile(b"|".join(nested), re.I if self.fold else 0) if nested else None

    def _opener(self, name: str) -> bytes:
        k = int(name[1:])
        return self.rules.lines[k] if name[0] == "l" else (self.rules.blocks if name[0] == "b" else self.rules.quotes)[k].open

    def _whole(self, name: str, opener: bytes) -> bytes:
        """An expression that takes a construct from its opener to its end, and always succeeds."""
        opener = opener.replace(rb"\A", b"^")
        if name[0] == "l":
            return opener + (rb"(?:" + _JOIN + rb"|[^\n])*+" if self.joins else rb"[^\n]*+")
        if name[0] == "q":
            return self._quoted(self.rules.quotes[int(name[1:])])
        p = self.rules.blocks[int(name[1:])]
        close = bounded(p.close) if self.fold or p.has("n") or p.has("L") else re.escape(p.close)
        return opener + rb"(?:.*?" + (b"^" if p.has("L") else b"") + close + rb"|.*)"

    def _quoted(self, p: Pair) -> bytes:
        close, any_byte = re.escape(p.close), rb"." if p.has("m") else rb"[^\n]"
        inner = []
        if self.joins:
            inner.append(_JOIN)
        if not p.has("0"):
            inner.append(rb"\\" + (rb"(?:" + _JOIN + rb")*+" if self.joins else b"") + any_byte)
        if p.has("d"):
            inner.append(close + close)
        inner.append(rb"(?!" + close + rb")" + any_byte)
        return re.escape(p.open) + rb"(?:" + b"|".join(inner) + rb")*+(?:" + close + rb")?"

    def _code(self, part: bytes) -> bytes:
        """Code between comments and strings; a backslash that joins lines is no ink."""
        return _LAST_BACKSLASH.sub(b"", part) if self.joins and b"\\" in part else part

    def without_comments(self, data: bytes) -> bytes:
        if self.plain and self.nested is None:
            pieces = self.any.split(data)
            pieces[1::2] = [b"\n" * x.count(b"\n") if x.startswith(self.comments) else x for x in pieces[1::2]]
            if self.joins:
                pieces[::2] = map(self._code, pieces[::2])
            return b"".join(pieces)
        out, at, pos = [], 0, 0
        while m := self.any.search(data, pos):
            name = next(n for text, n in self.openers if m[0].startswith(text)) if self.plain else m.lastgroup
            start, pos = m.span()
            if self.numbers and data[start] == 39 and digit_separator(data[data.rfind(b"\n", 0, start) + 1 : start + 2], start - data.rfind(b"\n", 0, start) - 1):
                pos = start + 1
                continue
            out.append(self._code(data[at:start]))
            if name[0] in "qrdh":  # strings, raw ones too
                out.append(m[0])
            else:
                if name[0] == "b" and self.nested and self.nested.search(m[0], 1):
                    pos = self._end_of_nested(data, start, int(name[1:]))
                out.append(b"\n" * data.count(b"\n", start, pos))
            at = pos
        out.append(self._code(data[at:]))
        return b"".join(out)

    def _end_of_nested(self, data: bytes, start: int, block: int) -> int:
        """Where the comment that opens at ``start`` ends, with all that open in it."""
        inside = compiled(self.rules).inside
        open_, pos = [block], start + len(self.rules.blocks[block].open)
        while open_:
            m = inside[open_[-1]].search(data, pos)
            if m is None:
                return len(data)
            if m.lastgroup and m.lastgroup != "end":
                open_.append(int(m.lastgroup[1:]))
            else:
                open_.pop()
            pos = m.end()
        return pos

    def counts(self, data: bytes) -> tuple[int, int, int]:
        """Code, comment and blank lines."""
        lines, inked = physical_line_count(data), ink_lines(data)
        n = ink_lines(self.without_comments(data))
        return n, inked - n, lines - inked


def _said(rules: Rules) -> tuple:
    return rules.lines, tuple((p.open, p.close) for p in rules.blocks), {(p.open, p.close) for p in rules.quotes}, {(p.open, p.close) for p in rules.docs}


def js_like(rules: Rules) -> bool:
    """Whether comments and strings are those of JavaScript."""
    return _said(rules) == ((b"//",), ((b"/*", b"*/"),), {(x, x) for x in (b'"', b"'", b"`")}, set()) and not rules.features & {"splice", "cont", "fold"}


def python_like(rules: Rules) -> bool:
    return _said(rules)[:2] == ((b"#",), ()) and {(x, x) for x in (b'"', b"'", b'"""', b"'''")} == _said(rules)[2] | _said(rules)[3] and "cont" in rules.features and "splice" not in rules.features


@lru_cache(maxsize=None)
def whole_file(rules: Rules):
    """The whole-file counter of a language, or None where only the line scanner will do."""
    from .tokenstreams import JavaScript, Python

    if "js" in rules.features and js_like(rules):
        return JavaScript()
    if "py" in rules.features and python_like(rules):
        return Python()
    if _BEYOND & rules.features or rules.docs or any(b"\\" in p.close or not p.close for p in (*rules.blocks, *rules.quotes)):
        return None
    return WholeFile(rules)
