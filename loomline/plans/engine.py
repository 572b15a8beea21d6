"""From files to counts: detect, filter, classify, deduplicate, aggregate.

The plan is one narrow pass (detect, filter and classify in one stage), one shuffle by digest where
copies are dropped, and one by language for the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytesets import JAVA_SPACES
from ..functions.classify import line_records
from ..functions.detect import AMBIGUOUS, base_name, directory, with_language
from ..functions.languages import Language, LanguageRegistry
from ..functions.linetable import counts_of_many
from ..operators.sorting import with_position
from ..sources.folders import work_dir, written
from ..sources.listing import VCS, can_prune, is_vcs, read_contents, sized_trees
from . import hugefiles
from .options import Options
from .patterns import compile_in

LINES = "seq long, path string, language string, line_no int, kind string, in_comment boolean, text binary, raw binary"
#: bytes of contents that a task turns to Python's objects at once
PIECE = 1 << 20
FILES = "name string, language string, code long, comment long, blank long"


@dataclass
class Result:
    """Lazy DataFrames of one analysis.

    ``scanned`` holds a row for each retained file; a path that was found twice counts twice in
    ``languages`` and ``total`` and once, the last, in ``files``.
    """

    scanned: DataFrame
    contents: DataFrame
    registry: LanguageRegistry
    warnings: DataFrame | None = None
    dropped: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()
    #: the chunks of huge files, which are not among ``contents``
    chunks: DataFrame | None = None
    chunk: int = hugefiles.CHUNK

    @property
    def files(self) -> DataFrame:
        last = Window.partitionBy("path").orderBy(F.col("seq").desc())
        rows = self.scanned.withColumn("rank", F.row_number().over(last)).where("rank = 1")
        return rows.select(F.col("path").alias("name"), "language", "code", "comment", "blank")

    @property
    def languages(self) -> DataFrame:
        return by_language(self.scanned)

    @property
    def total(self) -> DataFrame:
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
        return self.scanned.agg(F.count(F.lit(1)).alias("files"), zero("code"), zero("comment"), zero("blank"))

    @property
    def max_path_length(self) -> DataFrame:
        return self.scanned.agg(F.coalesce(F.max(F.octet_length("path")), F.lit(0)).cast("long").alias("max_path_length"))

    @property
    def language_files(self) -> DataFrame:
        """name, seq and file: the paths of each language, seq being the order of discovery.  A row for
        each, for a language may have a third of all files."""
        return self.scanned.select(F.col("language").alias("name"), "seq", F.col("path").alias("file"))

    @property
    def lines(self) -> DataFrame:
        """seq, path, language, line_no, kind, in_comment, text, raw of retained files only."""
        kept = self.scanned.select("seq", "path").withColumnsRenamed({"seq": "s", "path": "p"})
        retained = lambda rows: rows.join(kept, (F.col("seq") == F.col("s")) & (F.col("path") == F.col("p")), "left_semi")
        rows = explode_lines(retained(self.contents), self.registry.languages)
        if self.chunks is None:
            return rows
        return rows.unionByName(hugefiles.lines_of(retained(self.chunks), self.registry.languages, _line_batch, LINES, self.chunk))

    @property
    def debug(self) -> DataFrame:
        """Line records with the running counts of their file."""
        upto = Window.partitionBy("seq", "path").orderBy("line_no")
        n = lambda k, name: F.sum((F.col("kind") == k).cast("long")).over(upto).alias(name)
        return self.lines.select("seq", "path", "line_no", "kind", n("C", "code"), n("M", "comment"), n("B", "blank"), "in_comment", "text")

    @property
    def debug_records(self) -> DataFrame:
        """``debug`` and, before the lines of a file, a record that it was opened (FILE) and one that its
        language was told by its content (LANG); both for copies that were dropped too."""
        rows = self.scanned.select("seq", "path", "language")
        if self.dropped is not None:
            rows = rows.unionByName(self.dropped.select("seq", "path", "language"))
        opened = rows.withColumns({"kind": F.lit("FILE"), "line_no": F.lit(0)})
        told = rows.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*AMBIGUOUS)).withColumns({"kind": F.lit("LANG"), "line_no": F.lit(-1)})
        return self.debug.unionByName(opened.unionByName(told), allowMissingColumns=True)

    @property
    def diagnostics(self) -> DataFrame:
        """Warnings, and the copies that deduplication dropped."""
        spark = self.scanned.sparkSession
        out = self.warnings if self.warnings is not None else spark.createDataFrame([], "seq long, path string, level string, message string")
        if self.dropped is not None:
            out = out.unionByName(self.dropped.select("seq", "path", F.lit("debug").alias("level"), F.lit("duplicate content").alias("message")))
        return out

    def unpersist(self) -> None:
        """Lets go of the counts that are kept for the reports."""
        for frame in self.held:
            frame.unpersist()

    def create_views(self) -> None:
        """Temporary views files, languages, total, lines and diagnostics."""
        for name in ("files", "languages", "total", "lines", "diagnostics"):
            getattr(self, name).createOrReplaceTempView(name)


def by_language(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).cast("long").alias(c) for c in ("code", "comment", "blank")])


def path_filters(path: Column, options: Options) -> Column:
    """The path predicates as one column; the exclusions are told first."""
    target = path if options.fullpath else base_name(path)
    folder = directory(path)
    out = F.lit(True)
    if options.not_match:
        out = out & ~target.rlike(options.java("not_match"))
    if options.match:
        out = out & target.rlike(options.java("match"))
    if options.not_match_dir:
        out = out & ~folder.rlike(options.java("not_match_dir"))
    if options.match_dir:
        out = out & folder.rlike(options.java("match_dir"))
    return out


def not_vcs(path: Column) -> Column:
    return ~path.rlike(VCS.pattern)


def language_filters(language: Column, options: Options, registry: LanguageRegistry) -> Column:
    out = F.lit(True)
    if excluded := options.excluded(registry.keys):
        out = out & ~language.isin(excluded)
    if (included := options.included(registry.languages)) is not None:
        out = out & language.isin(included)
    return out


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose contents have ``most`` bytes together, or are one."""
    start, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column("content")).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size or 0
    yield batch.slice(start)


def classified(rows: DataFrame, languages: dict[str, Language]) -> DataFrame:
    """Adds code, comment and blank to rows with language and content, dropping the content."""
    names = [c for c in rows.columns if c != "content"]
    schema = rows.select(*names).schema
    for c in ("code", "comment", "blank"):
        schema = schema.add(c, "long")

    def count(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            contents, by = [x or b"" for x in batch.column("content").to_pylist()], {}
            for k, name in enumerate(batch.column("language").to_pylist()):
                by.setdefault(name, []).append(k)
            got: list = [None] * batch.num_rows
            for name, places in by.items():
                for k, told in zip(places, counts_of_many([contents[k] for k in places], languages[name]), strict=True):
                    got[k] = told
            columns = list(zip(*got, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, pa.int64()) for c in columns)], names=[*names, "code", "comment", "blank"])

    return rows.mapInArrow(count, schema)


def explode_lines(rows: DataFrame, languages: dict[str, Language]) -> DataFrame:
    """One row for each physical line of rows with seq, path, language and content."""

    def lines(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            for seq, path, name, content in zip(*(batch.column(c).to_pylist() for c in ("seq", "path", "language", "content")), strict=True):
                held: list[tuple] = []
                size = 0
                for number, record in enumerate(line_records(content or b"", languages[name]), 1):
                    held.append((seq, path, name, number, *record))
                    size += len(record[3])
                    if len(held) == 10_000 or size > PIECE:
                        yield _line_batch(held)
                        held, size = [], 0
                if held:
                    yield _line_batch(held)

    return rows.select("seq", "path", "language", "content").mapInArrow(lines, LINES)


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary())
    names = ("seq", "path", "language", "line_no", "kind", "in_comment", "text", "raw")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def count_plain(rows: DataFrame) -> DataFrame:
    """The counts of languages without any marker, in native expressions: a line is code or blank."""
    text = F.col("content").cast("string")
    pieces = F.split(text, "\n")
    lines = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    rows = rows.withColumn("__lines", lines)
    n = F.size("__lines").cast("long")
    blank = F.size(F.filter("__lines", lambda x: x.rlike(f"^{JAVA_SPACES}*$"))).cast("long")
    names = [c for c in rows.columns if c not in ("content", "__lines")]
    return rows.select(*names, (n - blank).alias("code"), F.lit(0).cast("long").alias("comment"), blank.alias("blank"))


def first_of_each(rows: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """Rows split into the first of each digest and all others; rows without a ``seq`` come last, ties
    go by path and then by what else the rows hold.

    The first row of a digest is the least of its rows as a whole, summed map-side, so a digest that a
    third of all rows share costs a row for each task.  The others are all rows less that one: rows are
    counted, and the first is looked up by all its columns, which no digest can make a hot key.
    """
    columns = [digest, "seq", "path", *(c for c in rows.columns if c not in (digest, "seq", "path"))]
    least = rows.groupBy(digest).agg(F.min(F.struct(F.col("seq").isNull().alias("unplaced"), *columns[1:])).alias("least"))
    first = least.select(digest, *(F.col(f"least.{c}").alias(c) for c in columns[1:]))
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    others = counted.unionByName(first.withColumn("times", F.lit(-1).cast("long"))).groupBy(*columns).agg(F.sum("times").alias("times")).where("times > 0")
    others = others.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return first.select(*rows.columns), others.select(*rows.columns)


def analyze_content(content: DataFrame, options: Options | None = None, registry: LanguageRegistry | None = None, language: str | None = None, persist: bool = True) -> Result:
    """Analyses rows of (seq long, path string, content string or binary).

    ``language`` names the language of all rows and turns detection off.  Rows of null content are
    empty files.  Contents are read once and never kept: copies are counted in the same pass and
    dropped by their digests afterwards, which costs less than a second reading or dealing contents by
    digest.  ``persist`` keeps the counts, one narrow row for each file, until ``Result.unpersist``.
    """
    return _analyze_rows(content, options or Options(), registry or LanguageRegistry.default(), language, persist)


def _analyze_rows(
    content: DataFrame,
    options: Options,
    registry: LanguageRegistry,
    language: str | None = None,
    persist: bool = True,
    warning: str | None = None,
    keep_partial: bool = False,
    huge: tuple[DataFrame, DataFrame] | None = None,
    chunk: int = hugefiles.CHUNK,
) -> Result:
    """``analyze_content``; the column ``warning``, if one is named, says what went wrong when a file was
    read.  What was read of such a file is counted with ``keep_partial`` only.  ``huge`` holds the counts and
    the chunks of files that are counted in chunks."""
    options.check(content.sparkSession)
    more = [F.col(warning)] if warning else []
    rows = content.select(F.col("seq").cast("long").alias("seq"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"), *more)
    rows = _in_language(rows.where(path_filters(F.col("path"), options)), options, registry, language)
    contents = rows.select("seq", "path", "language", "content", *more)
    work = contents.withColumn("digest", F.md5("content")) if options.dedup else contents
    plain = language is not None and _markerless(registry.languages[language])
    scanned = count_plain(work) if plain else classified(work, registry.languages)
    if huge is not None:
        columns = [c for c in scanned.columns]
        scanned = scanned.unionByName(huge[0].withColumnRenamed("warning", warning).select(*columns))
    held: tuple[DataFrame, ...] = ()
    if persist and not plain:
        scanned = scanned.persist(StorageLevel.MEMORY_AND_DISK)
        held = (scanned,)
    warnings = dropped = None
    if more:
        bad = F.col(warning).isNotNull()
        warnings = scanned.where(bad).select("seq", "path", F.lit("warning").alias("level"), F.col(warning).alias("message"))
        if not keep_partial:
            scanned, contents = scanned.where(~bad), contents.where(~bad)
        scanned, contents = scanned.drop(warning), contents.drop(warning)
    if options.dedup:
        scanned, dropped = first_of_each(scanned)
        scanned, dropped = scanned.drop("digest"), dropped.drop("digest")
    return Result(scanned, contents, registry, warnings, dropped, held, huge[1] if huge is not None else None, chunk)


def _in_language(rows: DataFrame, options: Options, registry: LanguageRegistry, language: str | None) -> DataFrame:
    if language is not None:
        return rows.withColumn("language", F.lit(language))
    return with_language(rows, registry.keys).where(language_filters(F.col("language"), options, registry))


def _markerless(language: Language) -> bool:
    rules = language.scanner_rules()
    if rules is not None:
        return False
    return not language.lines and not language.patterns and all(a == "" for a, _ in language.blocks)


def analyze(spark: SparkSession, paths, options: Options | None = None, registry: LanguageRegistry | None = None, huge: int = hugefiles.HUGE, chunk: int = hugefiles.CHUNK) -> Result:
    """Analyses files below ``paths``; an empty list gives an empty result.

    Files of ``huge`` bytes and more are counted by many tasks, ``chunk`` bytes each; identical ones among
    them are copies of each other, as long as their sizes are the same.
    """
    options, registry = options or Options(), registry or LanguageRegistry.default()
    options.check(spark)
    paths = list(paths)
    prune = compile_in(spark, options.not_match_dir) if can_prune(options.not_match_dir) else None
    left_out = (lambda path: (path != ".") & path.rlike(options.java("not_match_dir"))) if prune is not None else None
    found = sized_trees(spark, paths, lambda path: prune is not None and prune.matcher(path).find(), left_out=left_out)
    rooted = {k for k, p in enumerate(paths) if is_vcs(p)}
    found = found.where(F.col("root_idx").isin(sorted(rooted)) | not_vcs(F.col("path")) | (F.col("warning") != "")) if rooted else found
    missing = found.where("warning <> ''").select("seq", "path", F.lit("warning").alias("level"), F.col("warning").alias("message"))
    wanted = found.where("warning = ''").where(path_filters(F.col("path"), options))
    told = options.with_(match="", not_match="", match_dir="", not_match_dir="")
    large = wanted.where(F.col("size") >= huge)
    counted = _count_large(large, told, registry, chunk) if large.count() else None
    read = read_contents(wanted.where(F.col("size") < huge), options.effective_workers(spark))
    result = _analyze_rows(read, told, registry, warning="warning", huge=counted, chunk=chunk)
    return replace(result, warnings=missing.unionByName(result.warnings))


def _count_large(large: DataFrame, options: Options, registry: LanguageRegistry, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Counts and chunks of huge files; those that can't be read have a warning and no counts."""
    told = _in_language(hugefiles.heads(large), options, registry, None).drop("content")
    told = written(told.select("seq", "path", "size", "language", "warning"), f"{work_dir(large.sparkSession)}/large")
    counts, places = hugefiles.count_huge(told.where("warning is null"), registry.languages, chunk)
    failed = told.where("warning is not null").select("seq", "path", "language", *[F.lit(0).cast("long").alias(c) for c in ("code", "comment", "blank")], F.lit("").alias("digest"), "warning")
    return counts.unionByName(failed), places


def analyze_files(spark: SparkSession, paths, language: Language | str) -> Result:
    """Files of a named language, each counted as far as it could be read; ``diagnostics`` has a warning
    for each that could not be read to its end.  ``paths`` is a list, or a DataFrame with a column path."""
    registry = LanguageRegistry.default()
    own = registry.languages[language] if isinstance(language, str) else language
    rows = with_position(paths.select("path"), [F.col("path")], "seq", 0) if isinstance(paths, DataFrame) else spark.createDataFrame(list(enumerate(paths)), "seq long, path string")
    read = read_contents(rows, Options().effective_workers(spark))
    return _analyze_rows(read, Options(), replace(registry, languages={own.name: own}), own.name, warning="warning", keep_partial=True)


def analyze_file(spark: SparkSession, path: str, language: Language | str) -> DataFrame:
    """One row for a file of a named language: the counts of what could be read of it."""
    return analyze_files(spark, [path], language).files


@dataclass
class Processor:
    """Analyses with a caller's languages."""

    spark: SparkSession
    registry: LanguageRegistry
    options: Options = Options()

    def analyze(self, paths) -> Result:
        return analyze(self.spark, paths, self.options, self.registry)
