"""Huge files, counted by many tasks: chunks of whole lines, their functions, and a walk that composes them.

Round 0 tries each chunk in the state in which it probably is entered.  In the next rounds each chunk is
counted for the states that the chunk before was found to end in, until no new state comes up: the states
of neighbouring chunks soon agree, so two or three rounds are enough for files that people write.  A file
whose states go on to differ (a comment nested deeper from chunk to chunk, a bracket that stays open) is
followed from where they do after ``SPREAD`` rounds, ``FOLLOW`` chunks by a task in each round, so work never
grows with the square of the chunks.

The walk reads what is known of a file in order, adds up counts along the states that follow from each
other and remembers the state and the line number that each chunk is entered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunkscan import GUESS, START, count_chunk, cut_lines, lines_of_chunk
from ..functions.languages import Language
from ..sources.folders import work_dir, written
from ..sources.stores import store_of

#: bytes beyond which a file is dealt to several tasks, and those of a chunk
HUGE = 256 << 20
CHUNK = 16 << 20
#: bytes from which a huge file's language is told
HEAD = 1 << 20
SPREAD = 4
FOLLOW = 64
#: tasks of a round at most; small chunks share one
TASKS = 20_000

_KEY = "seq long, path string, language string, chunk long, n long, entry string"
_COUNTS = "code long, comment long, blank long"
_NUMBERS = ("seq", "chunk", "n", "code", "comment", "blank")


def read_chunk(path: str, chunk: int, size: int) -> bytes:
    start = chunk * size
    begin = max(start - 1, 0)
    return cut_lines(store_of(path).chunks(path, begin), begin, start, start + size)


def heads(huge: DataFrame, size: int = HEAD) -> DataFrame:
    """seq, path and size with the first bytes as content, and a warning where they can't be read."""

    def read(batches):
        for batch in batches:
            for seq, path, total in zip(*(batch.column(c).to_pylist() for c in ("seq", "path", "size")), strict=True):
                held, warning = b"", None
                try:
                    for piece in store_of(path).chunks(path):
                        held += piece
                        if len(held) >= size:
                            break
                except OSError as e:
                    warning = f"{path}: {e.strerror or e}"
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([path]), pa.array([total], pa.int64()), pa.array([held[:size]], pa.binary()), pa.array([warning], pa.string())], names=["seq", "path", "size", "content", "warning"])

    return huge.select("seq", "path", "size").mapInArrow(read, "seq long, path string, size long, content binary, warning string")


def _scan(asked: DataFrame, languages: dict[str, Language], size: int, follow: int = 1) -> DataFrame:
    """The counts, the state after and a digest of each chunk for each state that is asked for, and of the
    chunks behind it in the states that follow, ``follow`` in all."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for _ in range(min(follow, row["n"] - row["chunk"])):
                    out = _count_one(row, languages, size)
                    yield pa.RecordBatch.from_pylist([out], schema=pa.schema([(k, pa.int64() if k in _NUMBERS else pa.string()) for k in out]))
                    row = {**row, "chunk": row["chunk"] + 1, "entry": out["after"]}

    return asked.select("seq", "path", "language", "chunk", "n", "entry").mapInArrow(count, f"{_KEY}, {_COUNTS}, after string, digest string, warning string")


def _count_one(row: dict, languages: dict[str, Language], size: int) -> dict:
    warning = None
    try:
        content = read_chunk(row["path"], row["chunk"], size)
    except OSError as e:
        content, warning = b"", f"{row['path']}: {e.strerror or e}"
    code, comment, blank, after = count_chunk(content, languages[row["language"]], row["entry"])
    return {**row, "code": code, "comment": comment, "blank": blank, "after": after, "digest": hashlib.md5(content).hexdigest(), "warning": warning}


def walk(known: DataFrame) -> DataFrame:
    """A row for each chunk that follows from a file's beginning: the state and the line it is entered
    with and its counts (``found``); and one for the first that is not known in its state."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, state, line, stopped = None, 0, START, 0, False
        key = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["seq"] != file:
                    if key is not None and not stopped and at < key["n"]:
                        out.append({**key, "chunk": at, "entry": state, "before": line, "code": 0, "comment": 0, "blank": 0, "found": False})
                    file, at, state, line, stopped, key = row["seq"], 0, START, 0, False, {k: row[k] for k in ("seq", "path", "language", "n")}
                if stopped or row["chunk"] < at:
                    continue
                if row["chunk"] > at:
                    stopped = True
                    out.append({**key, "chunk": at, "entry": state, "before": line, "code": 0, "comment": 0, "blank": 0, "found": False})
                elif row["entry"] == state:
                    out.append({**key, "chunk": at, "entry": state, "before": line, **{c: row[c] for c in ("code", "comment", "blank")}, "found": True})
                    at, state, line = at + 1, row["after"], line + row["code"] + row["comment"] + row["blank"]
            if out:
                yield _walked(out)
        if key is not None and not stopped and at < key["n"]:
            yield _walked([{**key, "chunk": at, "entry": state, "before": line, "code": 0, "comment": 0, "blank": 0, "found": False}])

    def _walked(rows):
        names = ("seq", "path", "language", "chunk", "n", "entry", "before", "code", "comment", "blank", "found")
        types = {"path": pa.string(), "language": pa.string(), "entry": pa.string(), "found": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.int64())) for k in names], names=list(names))

    dealt = known.select("seq", "path", "language", "chunk", "n", "entry", "after", "code", "comment", "blank").repartition("seq").sortWithinPartitions("seq", "chunk")
    return dealt.mapInArrow(follow, f"{_KEY}, before long, {_COUNTS}, found boolean")


def count_huge(files: DataFrame, languages: dict[str, Language], size: int = CHUNK, spread: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Of rows of seq, path, size and language: seq, path, language, counts, digest and warning of each
    file; and the places of its chunks, for ``lines_of``."""
    base = work_dir(files.sparkSession)
    least = 4 * files.sparkSession.sparkContext.defaultParallelism
    n = F.greatest(F.ceil(F.col("size") / size), F.lit(1)).cast("long")
    asked = files.select("seq", "path", "language", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"), n.alias("n"))
    asked = asked.withColumn("entry", F.when(F.col("chunk") == 0, F.lit(START)).otherwise(F.lit(GUESS)))
    asked = written(asked, f"{base}/chunks")
    known, waiting, step = None, asked.count(), 0
    while waiting:
        got = written(_scan(asked.repartition(min(waiting, max(least, -(-waiting * size // CHUNK)), TASKS)), languages, size, 1 if step < spread else FOLLOW), f"{base}/round{step}")
        known = got if known is None else known.unionByName(got)
        step += 1
        if step < spread:
            more = got.where(F.col("chunk") + 1 < F.col("n")).select("seq", "path", "language", (F.col("chunk") + 1).alias("chunk"), "n", F.col("after").alias("entry")).distinct()
            asked = more.join(known.select("seq", "chunk", "entry"), ["seq", "chunk", "entry"], "left_anti")
        else:
            asked = walk(known).where("not found").drop("before", "code", "comment", "blank", "found")
        asked = written(asked, f"{base}/asked{step}")
        waiting = asked.count()
    if known is None:
        known = _scan(asked, languages, size)
    places = written(walk(known), f"{base}/places")
    first = known.where((F.col("entry") == START) | (F.col("entry") == GUESS))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
    digests = first.groupBy("seq").agg(F.concat(F.lit("chunks:"), F.md5(F.array_join(parts, ""))).alias("digest"), F.max("warning").alias("warning"))
    sums = places.groupBy("seq", "path", "language").agg(*[F.sum(c).alias(c) for c in ("code", "comment", "blank")])
    return sums.join(digests, "seq").select("seq", "path", "language", "code", "comment", "blank", "digest", "warning"), places


def lines_of(places: DataFrame, languages: dict[str, Language], batch_of, schema: str, size: int = CHUNK) -> DataFrame:
    """The line records of all chunks, numbered through their files."""

    def lines(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                content = read_chunk(row["path"], row["chunk"], size)
                for number, record in enumerate(lines_of_chunk(content, languages[row["language"]], row["entry"]), row["before"] + 1):
                    held.append((row["seq"], row["path"], row["language"], number, *record))
                    if len(held) == 10_000:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    rows = places.select("seq", "path", "language", "chunk", "entry", "before")
    return rows.mapInArrow(lines, schema)
