"""Command line: ``python -m loomline [options] PATH...``"""

from __future__ import annotations

import argparse
import sys
from importlib import metadata

from . import __version__
from .operators.output import OUTPUT_TYPES, write_report
from .operators.sorting import LANGUAGE_SORTS
from .plans.options import OptionError, Options


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise OptionError("arguments", message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="loomline", allow_abbrev=False, description="Counts code, comment and blank lines.")
    p.add_argument("paths", nargs="*", metavar="PATH")
    p.add_argument("-f", "--by-file", action="store_true", help="a row for each file")
    p.add_argument("-s", "--sort", default="code", help="|".join(LANGUAGE_SORTS))
    p.add_argument("-o", "--output-type", default="default", help="|".join(OUTPUT_TYPES))
    p.add_argument("-e", "--exclude-ext", default="", help="extensions to leave out, by commas")
    p.add_argument("-l", "--include-lang", default="", help="languages to keep, by commas")
    p.add_argument("--match", default="", help="file name pattern")
    p.add_argument("--not-match", default="", help="file name pattern to leave out")
    p.add_argument("--match-d", default="", help="directory pattern")
    p.add_argument("--not-match-d", default="", help="directory pattern to leave out")
    p.add_argument("--fullpath", action="store_true", help="match whole paths")
    p.add_argument("--debug", action="store_true", help="line records on stderr")
    p.add_argument("-w", "--workers", help="1 to 64")
    p.add_argument("--dedup", nargs="?", const="true", help="identical contents once")
    p.add_argument("--skip-duplicated", nargs="?", const="true", help="=false drops duplicates (older option)")
    p.add_argument("-L", "--show-lang", action="store_true", help="languages and extensions")
    p.add_argument("-V", "--version", action="store_true")
    return p


def version() -> str:
    """That of the installed package, or of this source tree."""
    try:
        return metadata.version("loomline")
    except metadata.PackageNotFoundError:
        return f"{__version__} (development)"


def _flag(name: str, value: str) -> bool:
    if value.lower() not in ("true", "false", "1", "0", "t", "f"):
        raise OptionError(name, f"not a boolean: {value!r}")
    return value.lower() in ("true", "1", "t")


def options_of(args: argparse.Namespace) -> Options:
    workers = 0
    if args.workers is not None:
        if not args.workers.isascii() or not args.workers.isdigit() or not 1 <= int(args.workers) <= 64:
            raise OptionError("workers", f"must be 1 to 64: {args.workers!r}")
        workers = int(args.workers)
    if args.dedup is not None and args.skip_duplicated is not None:
        raise OptionError("dedup", "can't be used with --skip-duplicated")
    if args.sort not in LANGUAGE_SORTS or (args.by_file and args.sort == "files"):
        raise OptionError("sort", f"unknown column: {args.sort!r}")
    if args.output_type not in OUTPUT_TYPES:
        raise OptionError("output-type", f"unknown type: {args.output_type!r}")
    dedup = _flag("dedup", args.dedup) if args.dedup is not None else args.skip_duplicated is not None and not _flag("skip-duplicated", args.skip_duplicated)
    split = lambda s: tuple(x for x in s.split(",") if x)
    return Options(workers, dedup, split(args.exclude_ext), split(args.include_lang), args.match, args.not_match, args.match_d, args.not_match_d, args.fullpath, args.debug)


def main(argv=None, out=None, err=None, spark=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        p = parser()
        args = p.parse_args(argv)
        options = options_of(args)
        if args.version:
            out.write(version() + "\n")
        elif args.show_lang:
            from .functions.languages import LanguageRegistry

            out.write(LanguageRegistry.default().formatted() + "\n")
        elif not args.paths:
            out.write(p.format_help())
        else:
            _run(args, options, out, err, spark)
    except (OptionError, ValueError, OSError) as e:
        err.write(f"error: {e}\n")
        return 1
    return 0


LINE_RECORDS = {"C": "CODE", "M": "COMM", "B": "BLNK"}


def _run(args, options: Options, out, err, spark) -> None:
    from pyspark.sql import SparkSession

    from .plans.engine import analyze

    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    result = analyze(spark, args.paths, options)
    for row in result.diagnostics.orderBy("seq").toLocalIterator():
        if row.level == "warning":
            err.write(f"warning: {row.message}\n")
        elif options.debug:
            err.write(f"[SKIP] file={row.path!r} reason={row.message!r}\n")
    if options.debug:
        for r in result.debug_records.orderBy("seq", "line_no").toLocalIterator():
            if r.kind == "LANG":
                err.write(f"[LANG] file={r.path!r} language={r.language!r}\n")
            elif r.kind == "FILE":
                err.write(f"[FILE] file={r.path!r}\n")
            else:
                err.write(f"[{LINE_RECORDS[r.kind]}] file={r.path!r} line={r.line_no} code={r.code} comment={r.comment} blank={r.blank} in_comment={str(r.in_comment).lower()} text={bytes(r.text)!r}\n")
    write_report(result, out, args.by_file, args.sort, args.output_type)
