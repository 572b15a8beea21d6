"""From the bytes of a file to a kind for each physical line: C code, M comment, B blank."""

from __future__ import annotations

from collections.abc import Iterator

from .bytesets import trim
from .languages import Language
from .linescan import LineScanner
from .plainscan import PlainScanner, plain_counts
from .wholefile import whole_file

_BOM = b"\xef\xbb\xbf"


def physical_lines(content: bytes) -> list[bytes]:
    """Lines with their terminators; nothing after the last line feed is no line."""
    lines = content.split(b"\n")
    last = lines.pop()
    return [x + b"\n" for x in lines] + ([last] if last else [])


def fresh_scanner(language: Language) -> LineScanner | PlainScanner:
    rules = language.scanner_rules()
    return PlainScanner(language) if rules is None else LineScanner(rules)


def line_records(content: bytes, language: Language) -> Iterator[tuple[str, bool, bytes, bytes]]:
    """(kind, inside a comment after it, trimmed text, raw line) for each physical line."""
    return records(content, language, fresh_scanner(language), True)


def records(content: bytes, language: Language, scan: LineScanner | PlainScanner, opens: bool) -> Iterator[tuple[str, bool, bytes, bytes]]:
    """``line_records`` of lines that a scanner goes on with; ``opens`` says that a file begins here."""
    if isinstance(scan, PlainScanner):
        for raw in physical_lines(content):
            text = trim(raw)
            if not text:
                yield "B", scan.in_comment, text, raw
                continue
            first = scan.first and not scan.waiting and not text.startswith(b"#!")
            kind = "C" if scan.is_code(text) else "M"
            yield kind, scan.in_comment, text.removeprefix(_BOM) if first else text, raw
        return
    for number, raw in enumerate(physical_lines(content)):
        text, line = trim(raw), raw
        if number == 0 and opens:
            line = raw.removeprefix(_BOM)
            text = trim(raw).removeprefix(_BOM)
            if text.startswith(b"#!"):
                yield "C", False, text, raw
                continue
        code = scan.is_code(line, text)
        yield ("C" if code else "M") if text else "B", scan.in_comment, text, raw


def kinds(content: bytes, language: Language) -> str:
    return "".join(r[0] for r in line_records(content, language))


def _opened(content: bytes) -> tuple[int, bytes] | None:
    """Lines of code that a file opens with (a first line of ``#!``), and the rest without a mark of its
    byte order; None where only the line scanner tells."""
    first, _, rest = content.partition(b"\n")
    opens = trim(first)
    if opens.removeprefix(_BOM).startswith(b"#!"):
        return 1, rest
    if first != _BOM and opens.startswith(_BOM) == first.startswith(_BOM):
        return 0, content.removeprefix(_BOM)
    return None


def counts(content: bytes, language: Language) -> tuple[int, int, int]:
    """Code, comment and blank lines: of the whole file at once where that can tell them."""
    rules = language.scanner_rules()
    if rules is not None and (whole := whole_file(rules)) is not None:
        if (opened := _opened(content)) is not None:
            code, comment, blank = whole.counts(opened[1])
            return code + opened[0], comment, blank
    elif rules is None and (got := plain_counts(content, language)) is not None:
        return got
    k = kinds(content, language)
    return k.count("C"), k.count("M"), k.count("B")


def counts_of(contents: list[bytes], language: Language) -> list[tuple[int, int, int]]:
    """``counts`` of many files, which languages with a counter for many share."""
    rules = language.scanner_rules()
    whole = whole_file(rules) if rules is not None else None
    if not hasattr(whole, "counts_of"):
        return [counts(c, language) for c in contents]
    opened = [_opened(c) for c in contents]
    told = iter(whole.counts_of([x[1] for x in opened if x is not None]))
    out = []
    for c, x in zip(contents, opened, strict=True):
        if x is None:
            out.append(counts(c, language))
        else:
            code, comment, blank = next(told)
            out.append((code + x[0], comment, blank))
    return out
