"""Counts of many files whose lines stand again.

A line is a function of the state that it is entered in: to a kind and the state after it.  What the line
scanner says of a line is kept by state, so a file of lines that were all met before is told by a look-up
for each.  What is kept is bounded; once it is full, a file goes to the whole-file counters at its first
line that isn't kept.
"""

from __future__ import annotations

from functools import lru_cache

from .chunkscan import START, count_chunk
from .classify import counts_of
from .languages import Language, Rules

#: lines that are kept of a language and of all together, bytes of a line or a state that is kept, and of a
#: file that is looked up
KNOWN, ALL, LINE, FILE = 500, 10_000, 200, 1 << 20
#: what a line of code and one of comment add; a blank one adds nothing
_CODE, _COMMENT = 1 << 32, 1


class _Lines(dict):
    """The lines that are kept of a state: what each adds, and the lines of the state after it.  A line
    stands without its line feed, a last line that has none behind one."""

    def __init__(self, table: LineTable, state: str):
        super().__init__({None: state})  # under a key that is no line
        self.table = table

    def __missing__(self, line: bytes) -> tuple[int, dict]:
        return self.table.learn(self, line)


class LineTable:
    """The lines of one language."""

    kept = 0  # of all languages

    def __init__(self, language: Language):
        self.language = language
        self.room = KNOWN
        self.states: dict[str, dict] = {}
        self.start = self._state(START)

    def _state(self, state: str) -> dict:
        if state not in self.states:
            self.states[state] = _Lines(self, state)
        return self.states[state]

    def learn(self, at: dict, line: bytes) -> tuple[int, dict]:
        """What a line adds and is followed by; ``KeyError`` for one that can't be kept."""
        if not self.room or LineTable.kept >= ALL or len(line) > LINE or len(at[None]) > LINE:
            raise KeyError(line)
        code, comment, _, after = count_chunk(line[1:] if line.startswith(b"\n") else line + b"\n", self.language, at[None])
        self.room -= 1
        LineTable.kept += 1
        at[line] = told = code * _CODE + comment * _COMMENT, self._state(after)
        return told

    def _opens_unknown(self, content: bytes) -> bool:
        feed = content.find(b"\n")
        return (content[:feed] if feed >= 0 else b"\n" + content) not in self.start

    def counts(self, content: bytes) -> tuple[int, int, int] | None:
        """Code, comment and blank lines; None for a file with lines that aren't kept."""
        if len(content) > FILE or (not self.room and content and self._opens_unknown(content)):
            return None
        lines, at, total = content.split(b"\n"), self.start, 0
        if last := lines.pop():
            lines.append(b"\n" + last)
        try:
            for line in lines:
                n, at = at[line]
                total += n
        except KeyError:
            return None
        code, comment = divmod(total, _CODE)
        return code, comment, len(lines) - code - comment


@lru_cache(maxsize=None)
def _table(language: Language, rules: Rules | None) -> LineTable:
    return LineTable(language)


def line_table(language: Language) -> LineTable:
    """Languages that are equal but for their rules have tables of their own."""
    return _table(language, language.scanner_rules())


def counts_of_many(contents: list[bytes], language: Language) -> list[tuple[int, int, int]]:
    """``counts_of``, with files of known lines looked up."""
    out = list(map(line_table(language).counts, contents))
    rest = [k for k, told in enumerate(out) if told is None]
    for k, told in zip(rest, counts_of([contents[k] for k in rest], language), strict=True):
        out[k] = told
    return out
