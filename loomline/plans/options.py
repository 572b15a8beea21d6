"""Options of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from .patterns import PatternError, compile_in, translate

MOST_WORKERS = 64
PATTERNS = ("match", "not_match", "match_dir", "not_match_dir")


class OptionError(ValueError):
    """An option that can't be used; raised before anything is read."""

    def __init__(self, field: str, reason: object):
        super().__init__(f"{field}: {reason}")
        self.field, self.reason = field, reason


@dataclass(frozen=True)
class Options:
    """``workers``: how many tasks read files; 0 takes the session's parallelism.  ``exclude_exts`` are extensions whose
    languages are excluded (or language names); an include list without any known name filters
    nothing.  Patterns search the base name, or the path as walked with ``fullpath``; directory
    patterns search the whole directory path.  ``strict_includes`` takes include names as given.
    """

    workers: int = 0
    dedup: bool = False
    exclude_exts: tuple[str, ...] = ()
    include_langs: tuple[str, ...] = ()
    match: str = ""
    not_match: str = ""
    match_dir: str = ""
    not_match_dir: str = ""
    fullpath: bool = False
    debug: bool = False
    strict_includes: bool = False

    def __post_init__(self):
        if not 0 <= self.workers <= MOST_WORKERS:
            raise OptionError("workers", f"must be 0 to {MOST_WORKERS}")
        for name in PATTERNS:
            try:
                translate(getattr(self, name))
            except PatternError as e:
                raise OptionError(name, e) from e
        object.__setattr__(self, "exclude_exts", tuple(self.exclude_exts))
        object.__setattr__(self, "include_langs", tuple(self.include_langs))

    @classmethod
    def from_legacy(cls, skip_duplicated: bool = True, workers: int = 1, **other) -> Options:
        """The older option set: deduplication on unless said otherwise, workers clamped, include
        names not validated."""
        return cls(dedup=skip_duplicated, workers=min(max(workers, 1), MOST_WORKERS), strict_includes=True, **other)

    def check(self, spark: SparkSession) -> None:
        """Raises if a pattern is none for the engine that matches it."""
        for name in PATTERNS:
            try:
                compile_in(spark, getattr(self, name))
            except PatternError as e:
                raise OptionError(name, e) from e

    def java(self, name: str) -> str:
        """A pattern as the engine takes it; empty for none."""
        return translate(getattr(self, name))

    def effective_workers(self, spark: SparkSession) -> int:
        return self.workers or spark.sparkContext.defaultParallelism

    def with_(self, **changes) -> Options:
        return replace(self, **changes)

    def excluded(self, keys: dict[str, str]) -> list[str]:
        """Language names to leave out."""
        return sorted({keys.get(e, e) for e in self.exclude_exts})

    def included(self, languages) -> list[str] | None:
        """Language names to keep, or None for all."""
        names = [n for n in self.include_langs if self.strict_includes or n in languages]
        return sorted(set(names)) if names or (self.strict_includes and self.include_langs) else None
