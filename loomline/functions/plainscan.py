"""The plain scanner: prefixes of trimmed lines and block pairs, without strings.

It serves the languages without rules and all languages that callers define.  Its habits are part of
the results: each sweep over the block pairs is followed by one byte that is not looked at, and the
first line that opens with ``#!``, wherever it stands, is code.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .bytesets import INK, trim
from .languages import Language

_BOM = b"\xef\xbb\xbf"
#: what a line begins with that may count but once in a file
_OPENS = (b"#!", _BOM)
#: lines of a file that are remembered
KNOWN = 1_000


class Markers:
    """The expressions of one language."""

    def __init__(self, language: Language):
        self.lines = tuple(x.encode() for x in language.lines)
        self.patterns = [re.compile(p.encode()) for p in language.patterns]
        self.pairs = [(a.encode(), b.encode()) for a, b in language.blocks]
        self.openers = tuple(a for a, _ in self.pairs if a)
        every = {x for pair in self.pairs for x in pair}
        #: any marker, and any that isn't empty
        self.any = re.compile(b"|".join(map(re.escape, sorted(every))) if every else rb"(?!)")
        self.real = re.compile(b"|".join(map(re.escape, sorted(every - {b""}))) if every - {b""} else rb"(?!)")
        sentinel = len(self.pairs) == 1 and not self.pairs[0][0]  # nothing is ever waited for
        self.special = re.compile(b"|".join(map(re.escape, [b"#!", _BOM, *([] if sentinel else sorted(every - {b""}, key=len))])))
        self._turns: dict[tuple[int, bytes | None], re.Pattern] = {}

    def turn(self, pair: int, innermost: bytes | None) -> re.Pattern:
        """What a pair reacts to while ``innermost`` is the closer that is waited for."""
        key = pair, innermost
        if key not in self._turns:
            opener, closer = self.pairs[pair]
            reacts = [b"(?P<open>" + re.escape(opener) + b")"] if innermost is None or opener != closer else []
            reacts += [b"(?P<close>" + re.escape(innermost) + b")"] if innermost is not None else []
            self._turns[key] = re.compile(b"|".join(reacts))
        return self._turns[key]


@lru_cache(maxsize=256)
def _markers(language: Language) -> Markers:
    return Markers(language)


class PlainScanner:
    def __init__(self, language: Language):
        self.m = _markers(language)
        self.waiting: list[bytes] = []  # closers, the innermost last
        self.first = True

    @property
    def in_comment(self) -> bool:
        return bool(self.waiting)

    def is_code(self, line: bytes) -> bool:
        """``line``: trimmed and not empty."""
        m = self.m
        if self.first and line.startswith(b"#!"):
            self.first = False
            return True
        if not self.waiting:
            if self.first:
                line = line.removeprefix(_BOM)
            commented = any(p.search(line) for p in m.patterns) if m.patterns else line.startswith(m.lines)
            if commented and not line.startswith(m.openers):
                return False
            if not m.real.search(line):
                return True
        if len(m.pairs) == 1 and not m.pairs[0][0]:
            return True
        return len(self._with_code(line)) == len(m.pairs)

    def _with_code(self, line: bytes) -> set[int]:
        """The pairs that see code on the line, stepping from marker to marker."""
        seen: set[int] = set()
        pos = 0
        while pos < len(line):
            stop = self.m.any.search(line, pos)
            upto = stop.start() if stop else len(line)
            if not self.waiting and (ink := INK.search(line, pos)) and ink.start() < upto:
                seen.update(range(len(self.m.pairs)))
            pos = self._at_marker(line, upto, seen) + 1 if stop else upto  # the byte after a marker isn't looked at
        return seen

    def _at_marker(self, line: bytes, pos: int, seen: set[int]) -> int:
        """Each pair has its turn, where the one before left off; where the last leaves off."""
        for pair, (_, closer) in enumerate(self.m.pairs):
            found = self.m.turn(pair, self.waiting[-1] if self.waiting else None).match(line, pos)
            if found is None:
                if not self.waiting and INK.match(line, pos):
                    seen.add(pair)
                continue
            if found.lastgroup == "open":
                self.waiting.append(closer)
            else:
                self.waiting.pop()
            pos = found.end()
        return pos


def plain_counts(content: bytes, language: Language) -> tuple[int, int, int] | None:
    """Code, comment and blank lines of a file.

    Lines in which no marker stands, nor what opens a script or marks the byte order, leave the scanner as
    it is: between two others they are all comment while a closer is waited for, and else told by how they
    begin.  So they are counted by stretches, and the scanner sees the others only, and of those that begin
    and end outside of comments each once.  None for languages of several pairs one of which has an empty
    marker, which stands everywhere.
    """
    m = _markers(language)
    if len(m.pairs) > 1 and any(not x for pair in m.pairs for x in pair):
        return None
    scanner = PlainScanner(language)
    known: dict[bytes, bool] = {}  # lines that leave the scanner as it is
    code = comment = blank = at = 0
    for found in iter(lambda: m.special.search(content, at), None):
        start = content.rfind(b"\n", at, found.start()) + 1 or at
        stop = content.find(b"\n", found.start()) + 1 or len(content)
        if start > at:
            told = _stretch(content[at:start], m, bool(scanner.waiting))
            code, comment, blank = code + told[0], comment + told[1], blank + told[2]
        text = trim(content[start:stop])
        at = stop
        if not text:
            blank += 1
            continue
        outside = not scanner.waiting
        if not outside or (is_code := known.get(text)) is None:
            is_code = scanner.is_code(text)
            if outside and not scanner.waiting and len(known) < KNOWN and not text.startswith(_OPENS):
                known[text] = is_code
        code, comment = code + is_code, comment + (not is_code)
    told = _stretch(content[at:], m, bool(scanner.waiting))
    return code + told[0], comment + told[1], blank + told[2]


def _stretch(part: bytes, m: Markers, waiting: bool) -> tuple[int, int, int]:
    """Code, comment and blank lines among whole lines without markers."""
    lines = part.split(b"\n")
    if not lines[-1]:
        lines.pop()
    texts = list(map(bytes.strip, lines) if part.isascii() else map(trim, lines))
    blank = texts.count(b"")
    if waiting:
        return 0, len(texts) - blank, blank
    if m.patterns:
        comment = sum(x != b"" and any(p.search(x) for p in m.patterns) for x in texts)
    else:
        comment = sum(x.startswith(m.lines) for x in texts) if m.lines else 0
    return len(texts) - blank - comment, comment, blank
