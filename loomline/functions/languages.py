"""The language registry: names, file name keys, lexical markers."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

BLANK = "␠"


@dataclass(frozen=True)
class Pair:
    """A block comment or quote."""

    open: bytes
    close: bytes
    flags: str = ""

    def has(self, flag: str) -> bool:
        return flag in self.flags


@dataclass(frozen=True)
class Rules:
    """Markers of the rule scanner."""

    lines: tuple[bytes, ...] = ()
    blocks: tuple[Pair, ...] = ()
    quotes: tuple[Pair, ...] = ()
    docs: tuple[Pair, ...] = ()
    features: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Language:
    """A language: ``Language(name, line_markers, block_pairs)``, or one of the built-in ones.

    Block pairs are two-element sequences; a pair of empty strings says that there are no blocks.
    ``patterns`` are regular expressions of whole line comments that replace the line markers.
    """

    name: str
    lines: tuple[str, ...] = ()
    blocks: tuple[tuple[str, str], ...] = (("", ""),)
    patterns: tuple[str, ...] = ()
    rules: Rules | None = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "lines", tuple(self.lines))
        object.__setattr__(self, "blocks", tuple(tuple(b) for b in self.blocks))
        object.__setattr__(self, "patterns", tuple(self.patterns))
        for p in self.patterns:
            re.compile(p)

    def with_patterns(self, patterns) -> Language:
        return Language(self.name, self.lines, self.blocks, tuple(patterns))

    def scanner_rules(self) -> Rules | None:
        """The rules to scan by, or None for the plain scanner.  A caller's Go, C or C Header with
        exactly the built-in markers is scanned like the built-in language."""
        if self.patterns or self.rules is not None:
            return None if self.patterns else self.rules
        if self.name in ("Go", "C", "C Header"):
            known = builtin()[self.name]
            if (self.lines, self.blocks) == (known.lines, known.blocks):
                return known.rules
        return None


def _pairs(cell: str) -> tuple[Pair, ...]:
    out = []
    for item in cell.split():
        first, second, *flags = item.replace(BLANK, " ").split("…")
        out.append(Pair(first.encode(), second.encode(), flags[0] if flags else ""))
    return tuple(out)


def _texts(cell: str) -> tuple[str, ...]:
    return tuple(x.replace(BLANK, " ") for x in cell.split())


#: the table that the package was made with; any other is refused
TABLE_SHA256 = "7aca9bf4fcb80e8021f1f6a21ad38d9c6ec5879c1b47cf82b02c09ad6be2cc06"
N_LANGUAGES, N_COLUMNS = 188, 11
SCANNERS = ("rules", "legacy")
FEATURES = frozenset("fast splice cont py js rust rawRust rawCpp fold fortran".split())
FLAGS = frozenset("nL\\0md")
# Fixed value: the one language whose opener may be both a comment and a string
_TWO_MEANINGS = ("VimL",)


class RuleTableError(ValueError):
    """A rule table that can't be right."""


def table_path() -> str:
    return str(resources.files(__package__).joinpath("languages.tsv"))


def read_rows(text: str) -> list[list[str]]:
    """The rows of a rule table, each with all its columns and nothing beyond."""
    rows = [line.split("\t") for line in text.splitlines() if not line.startswith("#")]
    for row in rows:
        if len(row) != N_COLUMNS:
            raise RuleTableError(f"{row[0]!r} has {len(row)} columns instead of {N_COLUMNS}")
        if not row[0] or row[5] not in SCANNERS:
            raise RuleTableError(f"{row[0]!r} has the scanner {row[5]!r}")
        if row[5] == "legacy" and any(row[6:]):
            raise RuleTableError(f"{row[0]!r} is scanned plainly but has rules")
    return rows


def languages_of(rows: list[list[str]]) -> tuple[dict[str, Language], dict[str, str]]:
    """Languages and keys of the rows of a table; every rule must make sense."""
    languages, keys = {}, {}
    for name, own, lines, blocks, pattern, scanner, r_lines, r_blocks, quotes, docs, features in rows:
        if name in languages:
            raise RuleTableError(f"{name!r} stands twice")
        rules = None
        if scanner == "rules":
            rules = Rules(tuple(x.encode() for x in _texts(r_lines)), _pairs(r_blocks), _pairs(quotes), _pairs(docs), frozenset(features.split()))
            unknown = set(rules.features - FEATURES) | {f for p in (*rules.blocks, *rules.quotes, *rules.docs) for f in p.flags if f not in FLAGS}
            wrong = check_rules(rules) if name not in _TWO_MEANINGS else []
            if "fast" in rules.features and not can_skip(rules):
                wrong.append("lines without // and /* can hold comments")
            if unknown or wrong:
                raise RuleTableError(f"{name!r}: {', '.join([*sorted(unknown), *wrong])}")
        pairs = tuple((p.open.decode(), p.close.decode()) for p in _pairs(blocks))
        languages[name] = Language(name, _texts(lines), pairs, (pattern.replace(BLANK, " "),) if pattern else (), rules)
        keys |= dict.fromkeys(own.split(), name)
    return languages, keys


def can_skip(rules: Rules) -> bool:
    """Whether every comment of a language opens with ``//`` or ``/*``."""
    return all(m.startswith((b"//", b"/*")) for m in (*rules.lines, *(p.open for p in rules.blocks))) and not rules.docs


@lru_cache(maxsize=1)
def _table() -> tuple[dict[str, Language], dict[str, str]]:
    raw = resources.files(__package__).joinpath("languages.tsv").read_bytes()
    if hashlib.sha256(raw).hexdigest() != TABLE_SHA256:
        raise RuleTableError("languages.tsv is not the table that this package was made with")
    languages, keys = languages_of(read_rows(raw.decode("utf-8")))
    if len(languages) != N_LANGUAGES:
        raise RuleTableError(f"{len(languages)} languages instead of {N_LANGUAGES}")
    return languages, keys


def rule_coverage() -> list[tuple[str, str, int, int, int, int, int]]:
    """Of each language: its name, its scanner, and how many keys, line markers, blocks, quotes and
    documentation quotes it has."""
    keys: dict[str, int] = {}
    rows = read_rows(resources.files(__package__).joinpath("languages.tsv").read_text("utf-8"))
    for row in rows:
        keys[row[0]] = len(row[1].split())
    out = []
    for name, language in builtin().items():
        r = language.rules or Rules()
        out.append((name, "rules" if language.rules else "legacy", keys[name], len(r.lines), len(r.blocks), len(r.quotes), len(r.docs)))
    return out


def builtin() -> dict[str, Language]:
    return _table()[0]


def check_rules(rules: Rules) -> list[str]:
    """Openers that mean two things, and pairs without an end: what a rule table must not have."""
    seen: dict[bytes, str] = {}
    wrong = []
    for kind, openers in (("line", rules.lines), ("block", [p.open for p in rules.blocks]), ("quote", [p.open for p in rules.quotes]), ("doc", [p.open for p in rules.docs])):
        for o in openers:
            if o in seen and seen[o] != kind:
                wrong.append(f"{o!r} is {seen[o]} and {kind}")
            seen[o] = kind
    wrong += [f"{p.open!r} has no end" for p in (*rules.blocks, *rules.quotes, *rules.docs) if not p.close or not p.open]
    return wrong


@dataclass
class LanguageRegistry:
    """Languages by name and file name keys (extensions and pseudo-extensions) by language."""

    languages: dict[str, Language]
    keys: dict[str, str]

    @classmethod
    def default(cls) -> LanguageRegistry:
        languages, keys = _table()
        return cls(dict(languages), dict(keys))

    def with_extension(self, key: str, language: str) -> LanguageRegistry:
        return LanguageRegistry(dict(self.languages), self.keys | {key: language})

    def with_language(self, language: Language) -> LanguageRegistry:
        return LanguageRegistry(self.languages | {language.name: language}, dict(self.keys))

    #: Keys that stand for the extension of a file name in listings
    SHOWN_AS = {"Objective-C": "m", "MATLAB": "m", "Mercury": "m", "F#": "fs", "GLSL": "fs", "TypeScript": "ts", "Motoko": "mo"}

    def listing(self) -> list[tuple[str, list[str]]]:
        """Each language by name with its extensions, sorted."""
        by: dict[str, set[str]] = {}
        for key, name in self.keys.items():
            by.setdefault(name, set()).add(self.SHOWN_AS.get(key, key))
        return sorted((name, sorted(by.get(name, ()))) for name in self.languages)

    def formatted(self) -> str:
        return "".join(f"{name:<30} ({', '.join(keys)})\n" for name, keys in self.listing())
