"""Counting a file in chunks of whole lines: what a chunk holds depends on the state that it is entered in.

A state is a scanner's memory between two lines, as text: equal states are equal texts.  A chunk is a
function from the state at its first line to counts and the state after its last, so a file is the
composition of its chunks' functions, each of which can be told for itself.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .classify import fresh_scanner, records
from .languages import Language
from .linescan import LineScanner
from .plainscan import PlainScanner

#: the state at the beginning of a file, and the one that a chunk is first tried with
START, GUESS = "", "?"

_FIELDS = ("quote", "escape_pending", "document", "line_comment", "raw_end")
_STATEMENT = ("margins", "goes_on", "depth", "header")


def state_of(scanner: LineScanner | PlainScanner) -> str:
    """The state between two lines; what is set anew by each line is no part of it."""
    if isinstance(scanner, PlainScanner):
        return repr((scanner.waiting, scanner.first))
    statements = [getattr(scanner.statements, f) for f in _STATEMENT] if scanner.statements else None
    return repr(([getattr(scanner, f) for f in _FIELDS], scanner.blocks, scanner.templates, scanner.operand if scanner.c.js else True, statements))


def scanner_in(language: Language, state: str) -> LineScanner | PlainScanner:
    scanner = fresh_scanner(language)
    if state in (START, GUESS):
        return scanner
    held = ast.literal_eval(state)
    if isinstance(scanner, PlainScanner):
        scanner.waiting, scanner.first = held
        return scanner
    fields, scanner.blocks, scanner.templates, scanner.operand, statements = held
    for f, x in zip(_FIELDS, fields, strict=True):
        setattr(scanner, f, x)
    for f, x in zip(_STATEMENT, statements or (), strict=False):
        setattr(scanner.statements, f, x)
    return scanner


def count_chunk(content: bytes, language: Language, entry: str) -> tuple[int, int, int, str]:
    """Code, comment and blank lines of a chunk that is entered in a state, and the state after it."""
    if not content:
        return 0, 0, 0, entry
    scanner = scanner_in(language, entry)
    kinds = "".join(r[0] for r in records(content, language, scanner, entry == START))
    return kinds.count("C"), kinds.count("M"), kinds.count("B"), state_of(scanner)


def lines_of_chunk(content: bytes, language: Language, entry: str) -> Iterator[tuple[str, bool, bytes, bytes]]:
    """As ``line_records``, of a chunk."""
    return records(content, language, scanner_in(language, entry), entry == START)


def cut_lines(pieces: Iterator[bytes], begin: int, start: int, stop: int) -> bytes:
    """The lines that start at ``start`` or later and before ``stop``, from the bytes of a file from
    ``begin`` on; ``begin`` is the byte before ``start``, or both are 0."""
    held: list[bytes] = []
    at, inside = begin, start == 0
    for piece in pieces:
        low = 0
        if not inside:
            feed = piece.find(b"\n")
            if feed < 0:
                at += len(piece)
                if at >= stop:
                    return b""
                continue
            low, inside = feed + 1, True
            if at + low >= stop:
                return b""
        # the line that holds the last byte before ``stop`` is the last one
        feed = piece.find(b"\n", max(low, stop - 1 - at)) if at + len(piece) >= stop else -1
        if feed >= 0:
            held.append(piece[low : feed + 1])
            return b"".join(held)
        held.append(piece[low:])
        at += len(piece)
    return b"".join(held)
