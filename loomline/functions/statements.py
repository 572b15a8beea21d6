"""Statements of the Python family, as far as documentation needs them.

A string is documentation if nothing but documentation stands before it in its line and the line begins
a statement whose margin lies in the range that the statement before has left: exactly the margin of the
file for the first one, anything further in after a whole header, nothing otherwise.
"""

from __future__ import annotations

import re

_BRACKETS = re.compile(rb"[()\[\]{}]")
# What a header begins with, the width of a tab
HEADERS = (b"def ", b"class ", b"async def ")
TAB = 8
_FAR = 1 << 30


def margin(line: bytes) -> int:
    return len(line[: len(line) - len(line.lstrip(b" \t"))].expandtabs(TAB))


class Statements:
    """Between two lines: the margins at which the next statement may open with documentation, whether the
    next line goes on with this one, its open brackets, and its margin if it is a header."""

    def __init__(self):
        self.margins: tuple[int, int] | None = (0, 0)
        self.goes_on = False
        self.depth = 0
        self.header: int | None = None

    def may_open_with_documentation(self, line: bytes, trimmed: bytes, in_string: bool) -> bool:
        """Told once for each line, before anything else of it."""
        if in_string or self.goes_on or not trimmed or trimmed.startswith(b"#"):
            return False
        at, margins = margin(line), self.margins
        self.margins = None
        if trimmed.startswith(HEADERS):
            self.header = at
        return margins is not None and margins[0] <= at <= margins[1]

    def line_ended(self, code: list[bytes], string_last: bool, in_string: bool) -> None:
        """``code``: the line without comments and strings; ``string_last``: whether a string follows it."""
        for bracket in _BRACKETS.findall(b" ".join(code)):
            self.depth = max(0, self.depth + (1 if bracket in b"([{" else -1))
        last = b"" if string_last or not code else code[-1].rstrip(b"\t\n\v\f\r ")[-1:]
        self.goes_on = self.depth > 0 or (not in_string and last == b"\\")
        if in_string or self.goes_on:
            return
        if self.header is not None and last == b":":
            self.margins = (self.header + 1, _FAR)
        self.header = None
