"""Patterns of the linear-time dialect, said in the dialect of Java's regular expressions.

Matching is Java's, in tasks and on the driver, so the two never differ.  A pattern is parsed to a tree
under the rules of its own dialect, which say what is valid (a brace that opens no count is a character, a
second quantifier is an error, counts end at 1,000) and what flags hold where, and the tree is printed
for Java with everything explicit: characters by their numbers, ends of lines and words by what stands
beside them, greediness by the quantifier.  Look-around, atomic groups, possessive quantifiers and
back-references are no part of the dialect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

# POSIX classes and what Java calls them, classes of one letter, escapes of characters
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
MOST = 1_000
_WORD_BEFORE, _WORD_AFTER = "(?<=[0-9A-Za-z_])", "(?=[0-9A-Za-z_])"
_NO_WORD_BEFORE, _NO_WORD_AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
EDGES = {
    "b": f"(?:{_WORD_BEFORE}{_NO_WORD_AFTER}|{_NO_WORD_BEFORE}{_WORD_AFTER})",
    "B": f"(?:{_WORD_BEFORE}{_WORD_AFTER}|{_NO_WORD_BEFORE}{_NO_WORD_AFTER})",
    "A": r"\A",
    "z": r"\z",
}
_COUNT = re.compile(r"\{(\d+)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_NAME = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_PROPERTY = re.compile(r"[pP](?:\{(\^?)([A-Za-z_]+)\}|([A-Za-z]))")


class PatternError(ValueError):
    """A pattern that the dialect doesn't have."""


@dataclass(frozen=True)
class Node:
    """A printed piece, and how often the pieces in it may be repeated by counts, multiplied."""

    java: str
    repeats: int = 1


class Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.flags = frozenset()
        self.names: set[str] = set()

    def fail(self, why: str):
        raise PatternError(f"{why}: {self.pattern!r}")

    def peek(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def whole(self) -> Node:
        node = self.alternatives()
        if self.at < len(self.pattern):
            self.fail("a parenthesis too much")
        return node

    def alternatives(self) -> Node:
        outer = self.flags
        parts = [self.sequence()]
        while self.peek("|"):
            self.at += 1
            parts.append(self.sequence())
        self.flags = outer  # flags hold to the end of their group
        return Node("|".join(p.java for p in parts), max(p.repeats for p in parts))

    def sequence(self) -> Node:
        out: list[Node] = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            before = self.at
            if (pieces := self.atom()) is None:  # flags: a quantifier takes what stands before them
                begin = self.at
                if self.quantifier() is not None and not out:
                    self.at = before
                    self.fail("a quantifier has nothing to repeat")
                self.at = begin
            else:
                out += pieces
            if out:
                out[-1] = self.repeated(out[-1])
        return Node("".join(n.java for n in out), max((n.repeats for n in out), default=1))

    def quantifier(self) -> tuple[str, int] | None:
        c = self.pattern[self.at : self.at + 1]
        if c and c in "*+?":
            self.at += 1
            return c, 1
        m = _COUNT.match(self.pattern, self.at)
        if m is None:
            return None
        least, most = int(m[1]), int(m[3]) if m[3] else None
        if m[3] and not m[2]:
            return None
        if least > MOST or (most or 0) > MOST or (most is not None and most < least):
            self.fail(f"{m[0]} is no count")
        self.at = m.end()
        return m[0], max(most if most is not None else least, 1)

    def repeated(self, node: Node) -> Node:
        found = self.quantifier()
        if found is None:
            return node
        lazy = self.peek("?")
        self.at += lazy
        before = self.at
        if self.quantifier() is not None:
            self.fail(f"{self.pattern[before : self.at]} follows a quantifier")
        repeats = node.repeats * found[1]
        if repeats > MOST:
            self.fail("counts within counts are too large")
        return Node(f"(?:{node.java}){found[0]}{'?' if lazy != ('U' in self.flags) else ''}", repeats)

    def atom(self) -> list[Node] | None:
        """Pieces of which a quantifier takes the last; None for flags, which are no piece."""
        c = self.pattern[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            return [self.bracket()]
        if c == "\\":
            return self.escape()
        before = self.at
        if c in "*+?" or (c == "{" and self.quantifier() is not None):
            self.at = before
            self.fail("a quantifier has nothing to repeat")
        self.at += 1
        if c == ".":
            return [Node(r"[\x{0}-\x{10FFFF}]" if "s" in self.flags else r"[^\n]")]
        if c == "^":
            return [Node(r"(?:\A|(?<=\n))" if "m" in self.flags else r"\A")]
        if c == "$":
            return [Node(r"(?:\z|(?=\n))" if "m" in self.flags else r"\z")]
        return [self.character(ord(c))]

    def folded(self, java: str) -> str:
        return f"(?iu:{java})" if "i" in self.flags else java

    def character(self, code: int) -> Node:
        return Node(self.folded(rf"\x{{{code:X}}}"))

    def group(self) -> list[Node] | None:
        if named := _NAME.match(self.pattern, self.at):
            if named[1] in self.names:
                self.fail(f"{named[1]} names two groups")
            self.names.add(named[1])
            self.at = named.end()
        elif self.peek("(?"):
            flags = _FLAGS.match(self.pattern, self.at)
            if flags is None or (flags[2] is None and "-" in flags[0]):
                self.fail("look-around and the like are not supported")
            self.at = flags.end()
            inner = (self.flags | set(flags[1])) - set(flags[2] or "")
            if flags[3] == ")":
                self.flags = inner
                return None
            outer, self.flags = self.flags, inner
            node = self.alternatives()
            self.flags = outer
            return self.closed(node)
        else:
            self.at += 1
        return self.closed(self.alternatives())

    def closed(self, node: Node) -> list[Node]:
        if not self.peek(")"):
            self.fail("a parenthesis has no end")
        self.at += 1
        return [Node(f"(?:{node.java})", node.repeats)]

    def escape(self) -> list[Node]:
        if self.peek(r"\Q"):
            stop = self.pattern.find(r"\E", self.at + 2)
            quoted = self.pattern[self.at + 2 :] if stop < 0 else self.pattern[self.at + 2 : stop]
            self.at = len(self.pattern) if stop < 0 else stop + 2
            return [self.character(ord(c)) for c in quoted]
        c = self.pattern[self.at + 1 : self.at + 2]
        if c and c in EDGES:
            self.at += 2
            return [Node(EDGES[c])]
        if (named := self.named_class()) is not None:
            return [Node(self.folded(f"[{named}]"))]
        return [self.character(self.escaped_character())]

    def named_class(self) -> str | None:
        """What stands for a class in Java's brackets, if a class of characters is named here."""
        c = self.pattern[self.at + 1 : self.at + 2]
        if c and c.lower() in PERL:
            self.at += 2
            return PERL[c] if c.islower() else f"[^{PERL[c.lower()]}]"
        if c and c in "pP":
            m = _PROPERTY.match(self.pattern, self.at + 1)
            if m is None:
                self.fail("a property has no name")
            self.at = m.end()
            name, out = m[2] or m[3], (c == "P") != bool(m[1])
            if name == "Any":
                return r"[^\x{0}-\x{10FFFF}]" if out else r"\x{0}-\x{10FFFF}"
            kind = name if len(name) <= 2 else f"Is{name}"  # general categories, or scripts
            return rf"\{'P' if out else 'p'}{{{kind}}}"
        return None

    def escaped_character(self) -> int:
        text, at = self.pattern, self.at + 1
        c = text[at : at + 1]
        if c in ESCAPES and c:
            self.at += 2
            return ESCAPES[c]
        if m := re.compile(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})").match(text, at):
            code = int(m[1] or m[2], 16)
            if code > 0x10FFFF:
                self.fail(f"{m[0]} is no character")
            self.at = m.end()
            return code
        if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(text, at):
            self.at = m.end()
            return int(m[0], 8)
        if c and ord(c) < 128 and not c.isalnum():
            self.at += 2
            return ord(c)
        self.fail(f"\\{c} is not supported")

    def bracket(self) -> Node:
        self.at += 1
        out = "^" if self.peek("^") else ""
        self.at += bool(out)
        parts: list[str] = []
        while not self.peek("]") or not parts:
            if self.at >= len(self.pattern):
                self.fail("a class has no end")
            if posix := _POSIX.match(self.pattern, self.at):
                if posix[2] != "word" and posix[2] not in POSIX:
                    self.fail(f"{posix[0]} is no class")
                self.at = posix.end()
                if posix[2] == "word":
                    parts.append(f"[^{PERL['w']}]" if posix[1] else PERL["w"])
                else:
                    parts.append(rf"\{'P' if posix[1] else 'p'}{{{POSIX[posix[2]]}}}")
                continue
            if self.peek("\\") and (named := self.named_class()) is not None:
                parts.append(named)
                continue
            low = self.member()
            if self.peek("-") and not self.pattern.startswith("-]", self.at) and self.at + 1 < len(self.pattern):
                self.at += 1
                high = self.member()
                if high < low:
                    self.fail("a range ends before it begins")
                parts.append(rf"\x{{{low:X}}}-\x{{{high:X}}}")
            else:
                parts.append(rf"\x{{{low:X}}}")
        self.at += 1
        return Node(self.folded(f"[{out}{''.join(parts)}]"))

    def member(self) -> int:
        if self.peek("\\"):
            return self.escaped_character()
        if self.at >= len(self.pattern):
            self.fail("a class has no end")
        self.at += 1
        return ord(self.pattern[self.at - 1])


def translate(pattern: str) -> str:
    """The pattern for Java; empty stays empty."""
    return Parser(pattern).whole().java if pattern else ""


def compile_in(spark: SparkSession, pattern: str):
    """The compiled Java pattern, None for an empty one."""
    if not pattern:
        return None
    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(translate(pattern))
    except IllegalArgumentException as e:
        raise PatternError(str(e)) from e
