"""WARC output (operator 2): seekable Zstandard bundles.

Each task writes one bundle.  Records are grouped into frames that decompress on their own; a seek
table in a skippable frame ends the file (the public seekable format).  The index, a Parquet table
beside the bundles, maps a record id to its bundle, frame, offset in the frame and length, so one
record costs one frame.  A bundle is written under an attempt's own name and renamed when it is
whole; the index names finished bundles only, so a task that ran twice leaves no double rows.

Equal payloads: the record of the largest ``page_id`` is the response, the others are revisits that
refer to it.  Only ids and digests are grouped, not payloads.

Defined results: a null html is an empty payload; payloads below ``least_bytes`` are all responses.
A null ``page_id`` counts as less than any other; rows that repeat the largest ``page_id`` of their
payload are all responses, and so are rows of a payload that has null ids alone.  Record ids are unique:
where rows repeat a ``page_id`` or have none, the record's bundle and place in it follow in its id, and a
revisit of such a page names the page in a field of its own.  A null url becomes ``urn:page:<id>``.  Extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_counted, materialize

FRAME_BYTES = 256 << 10
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: stands for WARC-Refers-To where several records have the id of the page that is referred to
REFERS_TO_PAGE = "X-Refers-To-Page"
# Fixed values of the seekable Zstandard format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, record_type string, payload_digest string, refers_to long, payload binary"


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def record_id(page_id: int | None, place: str = "") -> str:
    """The id of a page's record; ``place`` tells those apart whose pages have one id, or none."""
    return f"<urn:page:{'null' if page_id is None else page_id}{':' if place else ''}{place}>"


def page_of(urn: str | None) -> int | None:
    page = (urn or "").strip("<>").split(":")[2:3]
    return int(page[0]) if page and page[0].lstrip("-").isdigit() else None


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "", one_target: bool = True) -> bytes:
    """``one_target``: whether one record alone has the page that is referred to."""
    urn = record_id(page_id, place)
    target = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) if url else urn.strip("<>")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{bare_sha1(payload)}"]
    block = HTTP + payload
    if refers_to is not None:
        head += [f"{'WARC-Refers-To' if one_target else REFERS_TO_PAGE}: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def open_store(uri: str):
    """A pyarrow file system and path: local folders, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the index."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # map-side combined: a payload that a third of all pages share costs one row for each task
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = join_counted(rows, materialize(groups, f"{path}/copies"), ["sha"], "n", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen")).alias("refers_to"))
    rows = _with_repeats(rows, f"{path}/repeats")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        packer = zstandard.ZstdCompressor(level=level)
        sizes: list[tuple[int, int]] = []
        index: list[tuple] = []
        frame, used, written = [], 0, 0
        with store.open_output_stream(f"{root}/.{name}", compression=None) as out:

            def close() -> None:
                nonlocal frame, used
                packed = packer.compress(b"".join(frame))
                out.write(packed)
                sizes.append((len(packed), used))
                frame, used = [], 0

            for batch in batches:
                for page, url, html, refers, repeats, target_repeats in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "repeats", "target_repeats")), strict=True):
                    place = f"{name.split('.')[0]}-{written}" if repeats else ""
                    raw = format_record(page, url, html.encode("utf-8"), refers, place, not target_repeats)
                    written += 1
                    if used and used + len(raw) > frame_bytes:
                        close()
                    index.append((page, record_id(page, place), "response" if refers is None else "revisit", name, len(sizes), used, len(raw)))
                    frame.append(raw)
                    used += len(raw)
                if len(index) >= 10_000:
                    yield index_batch(index)
                    index = []
            if used:
                close()
            out.write(seek_table(sizes))
        store.move(f"{root}/.{name}", f"{root}/{name}")
        if index:
            yield index_batch(index)

    return materialize(rows.mapInArrow(write, INDEX), f"{path}/index")


def _with_repeats(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with repeats and target_repeats: whether other rows have the page's id (or it has none), and
    that of the page referred to.  Mostly there are none such, and nothing is joined."""
    counts = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or page_id is null")
    counts = materialize(counts, path)
    if counts.isEmpty():
        return rows.withColumns({"repeats": F.lit(False), "target_repeats": F.lit(False)})
    known = counts.where("page_id is not null")
    own = join_counted(rows, known, ["page_id"], how="left").withColumn("repeats", F.col("k").isNotNull() | F.col("page_id").isNull()).drop("k")
    # many pages may refer to one: that many rows have the key
    asked = own.groupBy("refers_to").agg(F.count(F.lit(1)).alias("k")).join(known.select(F.col("page_id").alias("refers_to")), "refers_to")
    both = join_counted(own, materialize(asked, f"{path}-asked"), ["refers_to"], how="left")
    return both.withColumn("target_repeats", F.col("k").isNotNull()).drop("k")


def index_batch(index: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def fetch_record(index: DataFrame, path: str, urn: str) -> tuple[dict[str, str], bytes] | None:
    """One record by its id: the index names the frame, which alone is read and decompressed."""
    import zstandard

    row = index.where(F.col("record_id") == urn).first()
    if row is None:
        return None
    store, root = open_store(path)
    with store.open_input_file(f"{root}/{row.bundle}") as file:
        start, packed, size = read_seek_table(file, file.size())[row.frame]
        file.seek(start)
        plain = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    return parse_record(plain[row.offset : row.offset + row.length])


def read_archives(spark: SparkSession, path: str, frames_a_task: int = 256) -> DataFrame:
    """All records, from the bundles themselves.  A task reads one run of frames: so many tasks are asked
    for by number, since Spark would put rows as few and small as these into one."""
    index = spark.read.parquet(f"{path}/index")
    work = index.select("bundle", F.floor(F.col("frame") / frames_a_task).alias("run")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = open_store(path)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, run in zip(batch.column("bundle").to_pylist(), batch.column("run").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{bundle}") as file:
                    frames = read_seek_table(file, file.size())[run * frames_a_task : (run + 1) * frames_a_task]
                    for start, packed, size in frames:
                        file.seek(start)
                        rows = list(parse_frame(unpack.decompress(file.read(packed), max_output_size=size)))
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "record_type", "payload_digest", "refers_to", "payload"])

    return work.repartition(max(work.count(), 1)).mapInArrow(read, RECORD)


def parse_frame(plain: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(plain):
        head = plain.index(b"\r\n\r\n", at)
        length = next(int(x[15:]) for x in plain[at:head].split(b"\r\n") if x[:15].lower() == b"content-length:")
        stop = head + 4 + length
        headers, payload = parse_record(plain[at:stop])
        yield page_of(headers["warc-record-id"]), headers["warc-type"], headers["warc-payload-digest"].partition(":")[2], page_of(headers.get("warc-refers-to") or headers.get(REFERS_TO_PAGE.lower())), payload
        at = stop + 4


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes the size of
    the payload it refers to."""
    kept = records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("n"))
    target = kept.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("t_page"), F.col("payload_digest").alias("t_digest")).agg(F.max("n").alias("t_n"))
    # grows with the input: a merge join at every size, never a broadcast
    joined = kept.join(target.hint("merge"), (F.col("refers_to") == F.col("t_page")) & (F.col("payload_digest") == F.col("t_digest")), "left")
    return joined.select("page_id", F.when(F.col("record_type") == "revisit", F.col("t_n")).otherwise(F.col("n")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
