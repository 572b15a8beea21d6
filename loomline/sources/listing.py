"""An ordered listing of source trees.

Spark's own file sources leave out names that start with a dot or underscore and empty files; a
count needs them all, in a defined order.  The driver lists a small tree by itself, up to
``DRIVER_FOLDERS`` folders and ``DRIVER_FILES`` files.  The folders that are left then are dealt to tasks, each of
which lists up to ``TASK_FOLDERS`` and gives back what it had no time for, which is dealt anew in the next
round: one deep folder is spread as soon as its folders are known.  Each round is written, and so is the
ordered listing, so an analysis lists once and all its views see the same numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sorting import with_position
from .folders import work_dir, written
from .stores import FILE, FOLDER, store_of

DRIVER_FOLDERS = 2_000
DRIVER_FILES = 100_000
TASK_FOLDERS = 500
SCHEMA = "seq long, root_idx int, path string, warning string, size long"
FOUND = "root_idx int, path string, warning string, size long"
#: bytes of contents that a task holds before it hands them on
HELD = 16 << 20
#: files of a folder that a task turns to columns at once
PART = 10_000
# Directory names of version control
VCS = re.compile(r"\.(bzr|cvs|hg|git|svn)")
#: what makes a match of a directory path not carry over to paths below it
_ENDS = re.compile(r"\$|\\[bBzZ]|\(\?[a-z]*m")

Entry = tuple[int, str, str, int]  # root number, path, warning, size
Open = tuple[int, str, bool]  # root number, path, whether folders of version control are left out


def is_vcs(path: str) -> bool:
    return bool(VCS.search(path.removeprefix("/")))


def can_prune(pattern: str) -> bool:
    """Whether a directory that ``pattern`` matches can be skipped with all below it."""
    return bool(pattern) and not _ENDS.search(re.sub(r"\\\\|\\\$|\[[^\]]*\]", "", pattern))


def list_folder(root: int, path: str, skip_vcs: bool, most: int | None = None) -> tuple[list[Entry], list[Open]] | None:
    """The files and the folders of one folder; one that can't be listed is a warning.  None if it holds
    more than ``most`` entries."""
    store = store_of(path)
    try:
        found = [(store.join(path, name), kind, size) for name, kind, size in islice(store.entries(path), None if most is None else most + 1)]
    except OSError as e:
        return [(root, path, str(e), 0)], []
    if most is not None and len(found) > most:
        return None
    found = [x for x in found if not (skip_vcs and is_vcs(x[0]))]
    return [(root, p, "", size) for p, kind, size in found if kind == FILE], [(root, p, skip_vcs) for p, kind, _ in found if kind == FOLDER]


def listed_parts(root: int, path: str, skip_vcs: bool, part: int = PART) -> tuple[list[pa.RecordBatch], list[Open]]:
    """``list_folder`` with the files as batches of ``part`` rows: a folder of very many files is held as
    columns, a fraction of what tuples take, until it is known that it can be listed to its end."""
    store = store_of(path)
    parts: list[pa.RecordBatch] = []
    folders: list[Open] = []
    try:
        entries = store.entries(path)
        while some := list(islice(entries, part)):
            found = [(store.join(path, name), kind, size) for name, kind, size in some]
            found = [x for x in found if not (skip_vcs and is_vcs(x[0]))]
            folders += [(root, p, skip_vcs) for p, kind, _ in found if kind == FOLDER]
            if own := [(root, p, "", size) for p, kind, size in found if kind == FILE]:
                parts.append(found_batch(own))
    except OSError as e:
        return [found_batch([(root, path, str(e), 0)])], []
    return parts, folders


def found_batch(rows: list[Entry], skip: list[bool] | None = None) -> pa.RecordBatch:
    k, path, warning, size = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(path, pa.string()), pa.array(warning, pa.string()), pa.array(size, pa.int64()), pa.array(skip or [None] * len(k), pa.bool_())], names=["root_idx", "path", "warning", "size", "skip_vcs"])


def walk(roots, pruned: Callable[[str], bool] = lambda path: False, most: int | None = None, most_files: int | None = None) -> tuple[list[Entry], list[Open]]:
    """All files below the roots, in no order, and the folders that are left after ``most`` listings or
    ``most_files`` files.

    A missing root gives a warning and no file.
    """
    files: list[Entry] = []
    level: list[Open] = []
    for k, root in enumerate(roots):
        store = store_of(root)
        kind = store.kind(root)
        if kind == FOLDER:
            level.append((k, store.clean(root), not is_vcs(root)))
        else:
            files.append((k, root, "" if kind else f"lstat {root}: no such file or directory", store.size(root) if kind else 0))
    listed = 0
    while level:
        below: list[Open] = []
        for i, (k, path, skip_vcs) in enumerate(level):
            if path != "." and pruned(path):
                continue
            got = list_folder(k, path, skip_vcs, None if most_files is None else max(most_files - len(files), 0)) if listed != most else None
            if got is None:
                return files, below + level[i:]
            listed += 1
            files += got[0]
            below += got[1]
        level = below
    return files, []


def order_of(path: str) -> bytes:
    """Sorts paths as a walk meets them: by name within each folder."""
    return path.encode("utf-8", "surrogateescape").replace(b"/", b"\0")


def list_trees(spark: SparkSession, roots, pruned: Callable[[str], bool] = lambda path: False, most: int = DRIVER_FOLDERS, **more) -> DataFrame:
    """seq, root_idx, path and warning of all files, in the order of a walk."""
    return sized_trees(spark, roots, pruned, most, **more).drop("size")


def sized_trees(spark: SparkSession, roots, pruned: Callable[[str], bool] = lambda path: False, most: int = DRIVER_FOLDERS, most_files: int = DRIVER_FILES, left_out: Callable[[Column], Column] | None = None, task_folders: int = TASK_FOLDERS) -> DataFrame:
    """``list_trees`` with the sizes of the files.

    ``pruned`` tells the driver which folders to skip, ``left_out`` tells the rounds of tasks.
    """
    files, left = walk(list(roots), pruned, most, most_files)
    if not left:
        files.sort(key=lambda x: (x[0], order_of(x[1])))
        k, path, warning, size = zip(*files, strict=True) if files else ((), (), (), ())
        rows = pa.table([pa.array(range(len(files)), pa.int64()), pa.array(k, pa.int32()), pa.array(path, pa.string()), pa.array(warning, pa.string()), pa.array(size, pa.int64())], names=["seq", "root_idx", "path", "warning", "size"])
        return spark.createDataFrame(rows, SCHEMA)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = 0
        for batch in batches:
            open_ = list(zip(*(batch.column(c).to_pylist() for c in ("root_idx", "path", "skip_vcs")), strict=True))
            while open_ and listed < task_folders:
                parts, folders = listed_parts(*open_.pop())
                open_ += folders
                listed += 1
                yield from parts
            if open_:
                yield found_batch([(k, path, "", 0) for k, path, _ in open_], [skip for _, _, skip in open_])

    base, most_tasks = work_dir(spark), 4 * spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame(files, FOUND)
    frontier, waiting, step = spark.createDataFrame(left, "root_idx int, path string, skip_vcs boolean"), len(left), 0
    while waiting:
        if left_out is not None:
            frontier = frontier.where(~left_out(F.col("path")))
        got = written(frontier.repartition(min(waiting, most_tasks)).mapInArrow(below, f"{FOUND}, skip_vcs boolean"), f"{base}/round{step}")
        listed = listed.unionByName(got.where("skip_vcs is null").drop("skip_vcs"))
        frontier = got.where("skip_vcs is not null").select("root_idx", "path", "skip_vcs")
        waiting, step = frontier.count(), step + 1
    return with_position(listed, [F.col("root_idx"), F.replace("path", F.lit("/"), F.lit("\0")), F.col("path")], "seq", 0).select("seq", "root_idx", "path", "warning", "size")


def read_whole(store, path: str) -> tuple[bytes | None, str | None]:
    """The bytes of a file, and a warning if reading broke off: then what came before, null if nothing did."""
    pieces: list[bytes] = []
    try:
        for piece in store.chunks(path):
            pieces.append(piece)
    except OSError as e:
        return b"".join(pieces) if pieces else None, f"{path}: {e.strerror or e}"
    return b"".join(pieces), None


def read_contents(candidates: DataFrame, workers: int) -> DataFrame:
    """seq, path, content and warning, read by ``workers`` tasks or more, a bounded number of bytes at a
    time.  Where reading fails midway, what came before stands in content; null if nothing could be read."""

    def read(batches):
        for batch in batches:
            held, size = [], 0
            for seq, path in zip(batch.column("seq").to_pylist(), batch.column("path").to_pylist(), strict=True):
                content, warning = read_whole(store_of(path), path)
                held.append((seq, path, content, warning))
                size += len(content or b"")
                if size > HELD:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def _batch(rows):
        seq, path, content, warning = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(warning, pa.string())], names=["seq", "path", "content", "warning"])

    return candidates.select("seq", "path").repartition(workers, "seq").mapInArrow(read, "seq long, path string, content binary, warning string")
