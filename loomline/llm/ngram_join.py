"""N-gram Jaccard join (operator 1): Bayesian candidate pruning.

A document is the set of its five-word shingles; two are linked where the Jaccard similarity of
their sets is 0.8 or more.  Documents of equal sets are one text (a node) from the start.

1. MinHash values in bands; nodes that share a band value are candidates.  32 bands of 4 values
   miss a pair of similarity 0.8 with probability 5e-8.
2. Buckets are merged into home groups by two rounds of least ids, so the pairs of a group of near
   copies are compared once and not once for each band.  Buckets whose nodes still have different
   homes are compared on their own, at the first band that a pair shares: no candidate is lost.
3. A group is dealt in blocks, by its shingles and by its texts; each task compares two blocks.  Within it,
   MinHash values are compared some at a time, and a pair goes when the posterior probability of
   reaching the threshold (uniform prior) falls below the tolerance.  What is left is verified on
   the exact sets.  Tasks return one row for each node - links, copies linked, root - not pairs.

Defined results: texts of one to four words have one shingle, all their words; texts without words
(null too) have none, link to nothing and are a class of their own.  Rows that repeat a doc_id are
documents of their own.  A row without doc_id is counted among the copies of its text; a class of
such rows alone has the null class id.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import join_counted, materialize, shared_dir, tidy, unused
from .textarrays import binary_array, doc_chunks, mix, prefix_sums, ranges, span_hash, utf8, whole_groups, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 8
TOLERANCE = 1e-8
#: shingles of one block; a task holds two blocks
BLOCK_SHINGLES = 1_000_000
#: texts of a group that are one block whatever they hold; k texts are sqrt(k / this) blocks
ROWS_ALONE = 16
ROUNDS = 2

_HASHES = BANDS * ROWS
_A = mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(10_001, 10_001 + _HASHES, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each document, and their offsets."""
    start, stop, at = words(data, offsets)
    sums = prefix_sums(word_hashes(data, start, stop))
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = ranges(at[:-1], count)
    last = np.minimum(first + size, np.repeat(at[1:], count))
    h = span_hash(sums, first, last)
    owner = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, owner))
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(len(n) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of documents that have shingles."""
    out = np.empty((len(at) - 1, _HASHES), np.uint32)
    for k in range(_HASHES if len(out) else 0):
        out[:, k] = np.minimum.reduceat(h * _A[k] + _B[k], at[:-1]) >> np.uint64(32)
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return acc


def digest_of(h: np.ndarray) -> bytes:
    """What tells texts apart: 128 bits over all shingles."""
    return hashlib.md5(h.tobytes()).digest()


def _sets(batch: pa.RecordBatch, size: int):
    data, off = utf8(batch.column("text"))
    for i, j in doc_chunks(off):
        h, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
        yield i, j, h, at


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = _HASHES, step: int = STEP) -> list[int]:
    """For h = step, 2 step, ...: the fewest equal values of h for which the posterior probability
    of ``threshold`` or more, 1 - I_t(m + 1, h - m + 1), is not below ``tolerance``."""
    out = []
    for h in range(step, hashes + 1, step):
        # I_t(m + 1, h - m + 1) = P(Binomial(h + 1, t) >= m + 1), so the posterior is P(... <= m)
        below = 0.0
        for m in range(h + 1):
            below += math.comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if below >= tolerance:
                out.append(m)
                break
    return out


def compare_group(node: np.ndarray, weight: np.ndarray, home: np.ndarray, side: np.ndarray, sig: np.ndarray, h: np.ndarray, at: np.ndarray, *, band: int, cross: bool, threshold: float, steps: list[int]) -> list[tuple[int, int, int, int]]:
    """(node, links, copies linked, root) of each node of one task that has a link in it.

    ``cross``: only pairs of different sides.  ``band`` >= 0: only pairs of different homes whose
    first common band it is.
    """
    m = len(node)
    exact = Fraction(threshold).limit_denominator(1_000_000)
    sizes = np.diff(at)
    vocabulary, ids = np.unique(h, return_inverse=True)
    mark = np.zeros(len(vocabulary), bool)
    links, copies = np.zeros(m, np.int64), np.zeros(m, np.int64)
    root = np.arange(m)
    bands = band_values(sig) if band >= 0 else None
    everyone = np.arange(m)
    for a in range(m - 1):
        b = everyone[a + 1 :]
        ok = np.minimum(sizes[a], sizes[b]) * exact.denominator >= np.maximum(sizes[a], sizes[b]) * exact.numerator
        if cross:
            ok &= side[b] != side[a]
        if band >= 0:
            ok &= home[b] != home[a]
        b = b[ok]
        if band >= 0 and len(b):
            same = bands[b] == bands[a]
            b = b[same.any(1) & (same.argmax(1) == band)]
        got = np.zeros(len(b), np.int32)
        for k, least in enumerate(steps):  # MinHash values, some at a time
            if not len(b):
                break
            part = slice(k * STEP, (k + 1) * STEP)
            got += (sig[b, part] == sig[a, part]).sum(1, dtype=np.int32)
            stay = got >= least
            if not stay.all():
                b, got = b[stay], got[stay]
        if not len(b):
            continue
        mark[ids[at[a] : at[a + 1]]] = True
        inter = np.add.reduceat(mark[ids[ranges(at[b], sizes[b])]].astype(np.int64), np.cumsum(sizes[b]) - sizes[b])
        mark[ids[at[a] : at[a + 1]]] = False
        union = sizes[a] + sizes[b] - inter
        b = b[inter * exact.denominator >= union * exact.numerator]
        if not len(b):
            continue
        links[a] += len(b)
        links[b] += 1
        copies[a] += weight[b].sum()
        copies[b] += weight[a]
        joined = np.unique(np.append(root[b], root[a]))
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return [(int(node[i]), int(links[i]), int(copies[i]), int(node[root[i]])) for i in np.flatnonzero(links)]


def jaccard_classes(documents: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, tolerance: float = TOLERANCE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each document: doc_id, class_id (least doc_id of its component), n_links (other
    documents linked, copies included), n_text_links (other texts linked)."""
    return _classes(documents, threshold, size, tolerance, block).select("doc_id", "class_id", "n_links", "n_text_links")


def _classes(documents: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, tolerance: float = TOLERANCE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``jaccard_classes`` with each row's node, the root of its class and ``row``, the column __row
    of ``documents`` if it has one."""
    spark = documents.sparkSession
    path = shared_dir(spark)
    row = F.col("__row") if "__row" in documents.columns else F.lit(None).cast("long")
    documents = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    steps = least_matches(threshold, tolerance)

    @tidy
    def sketch(batches):
        for batch in batches:
            for i, j, h, at in _sets(batch, size):
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = np.append(at[:-1][some], at[-1])
                bands = band_values(signatures(h, starts)).view(np.int64)
                digests: list[bytes | None] = [digest_of(h[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("key").slice(i, j - i),
                        batch.column("row").slice(i, j - i),
                        pa.array(digests, pa.binary()),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(some, np.arange(j - i + 1)).astype(np.int32) * BANDS), pa.array(bands.reshape(-1))),
                    ],
                    names=["doc_id", "key", "row", "digest", "n", "bands"],
                )

    drawn = materialize(documents.mapInArrow(sketch, "doc_id long, key long, row long, digest binary, n int, bands array<long>"), f"{path}/drawn")
    # each text is a node by a number of its own, given where it is written
    texts = drawn.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = texts.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("least.doc_id").alias("doc"), F.col("least.key").alias("key"), "copies", "n", "bands")
    texts = materialize(texts, f"{path}/texts")

    buckets = texts.select("node", F.posexplode("bands").alias("band", "value"))
    shared = buckets.groupBy("value").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("least")).where("k > 1")
    held = materialize(join_counted(buckets, materialize(shared, f"{path}/shared"), ["value"]), f"{path}/held")  # (value, node, band, k, least)
    home = held.groupBy("node").agg(F.min("least").alias("home"))
    for r in range(1, ROUNDS):
        least = held.join(home, "node").groupBy("value").agg(F.first("k").alias("of"), F.min("home").alias("to"))
        least = materialize(least, f"{path}/least{r}")
        home = materialize(join_counted(held.select("value", "node"), least, ["value"], "of").groupBy("node").agg(F.min("to").alias("home")), f"{path}/home{r}")
    apart = held.join(home, "node").groupBy("value").agg(F.first("k").alias("of"), F.min("home").alias("x"), F.max("home").alias("y")).where("x <> y")
    apart = materialize(apart.select("value", "of"), f"{path}/apart")
    facts = texts.select("node", "digest", "doc", "key", "copies", "n")
    alone = home.select(F.col("home").alias("gkey"), F.lit(-1).alias("band"), "node", "home")
    tasks = alone.unionByName(join_counted(held.select("value", "band", "node"), apart, ["value"], "of").join(home, "node").select(F.col("value").alias("gkey"), "band", "node", "home"))
    tasks = materialize(tasks.join(facts, "node"), f"{path}/tasks")
    # blocks bound the shingles of a task; with sqrt(k) of them a task's rows and the copies that are
    # dealt both grow with the square root of the group
    g = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sqrt(F.count(F.lit(1)) / ROWS_ALONE))).cast("int")
    blocks = materialize(tasks.groupBy("gkey", "band").agg(g.alias("g"), F.count(F.lit(1)).alias("k")).where("k > 1"), f"{path}/blocks")
    tasks = join_counted(tasks, blocks, ["gkey", "band"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("g")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct("gkey", "band", F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), "own", "home"))
    work = tasks.groupBy("node", "digest", "doc", "key", "copies").agg(F.flatten(F.collect_list(places)).alias("places"))
    work = materialize(work, f"{path}/work")

    @tidy
    def deal(batches):
        """The shingles and MinHash values of each node, a row for each task that needs them."""
        for batch in batches:
            wanted = batch.column("digest").to_pylist()
            for i, j, h, at in _sets(batch, size):
                n = np.diff(at)
                mine = np.array([n[k] > 0 and digest_of(h[at[k] : at[k + 1]]) == wanted[i + k] for k in range(j - i)], bool)
                rows = np.flatnonzero(mine)
                if not len(rows):
                    continue
                h = h[ranges(at[rows], n[rows])]
                at = np.append(0, np.cumsum(n[rows]))
                sig = signatures(h, at)
                lists = batch.column("places").take(pa.array(i + rows))
                which = np.repeat(np.arange(len(rows)), np.diff(np.asarray(lists.offsets)))
                flat = lists.flatten()
                for lo in range(0, len(which), 512):
                    w = which[lo : lo + 512]
                    take = pa.array(i + rows[w])
                    sizes = n[rows][w]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(flat.field(c).slice(lo, len(w)) for c in range(6)),
                            batch.column("node").take(take),
                            batch.column("copies").take(take),
                            binary_array(np.ascontiguousarray(sig[w]).view(np.uint8).reshape(-1), np.arange(len(w) + 1) * 4 * _HASHES),
                            binary_array(h[ranges(at[:-1][w], sizes)].view(np.uint8), 8 * np.append(0, np.cumsum(sizes))),
                        ],
                        names=["gkey", "band", "i", "j", "own", "home", "node", "copies", "sig", "shingles"],
                    )

    # both sides grow with the input: a merge join at every size, never a broadcast
    # rows without an id are found by their text, copies of one text once
    held_by = documents.where("doc_id is not null").unionByName(documents.where("doc_id is null").dropDuplicates(["text"]))
    work = work.withColumnRenamed("key", "of")
    dealt = held_by.join(work.hint("merge"), (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "node", "digest", "copies", "places").mapInArrow(deal, "gkey long, band int, i int, j int, own int, home long, node long, copies long, sig binary, shingles binary")
    keys = ["gkey", "band", "i", "j"]

    @tidy
    def compare(batches):
        for t in whole_groups(batches, *keys):
            key = [t.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            out = []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                g = t.slice(lo, hi - lo)
                node, first = np.unique(g.column("node").to_numpy(), return_index=True)
                sets = [np.frombuffer(x, np.uint64) for x in (g.column("shingles")[int(k)].as_py() for k in first)]
                sig = np.frombuffer(b"".join(g.column("sig")[int(k)].as_py() for k in first), np.uint32).reshape(len(first), -1)
                i, j, band = int(key[2][lo]), int(key[3][lo]), int(key[1][lo])
                out += compare_group(node, g.column("copies").to_numpy()[first], g.column("home").to_numpy()[first], g.column("own").to_numpy()[first], sig, np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), band=band, cross=i != j, threshold=threshold, steps=steps)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["node", "links", "linked", "root"])

    found = dealt.repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, linked long, root long")
    found = materialize(found, f"{path}/found")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), f"{path}/components")
    nodes = texts.select("node", "digest", "doc", "copies").join(totals, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.groupBy("root").agg(F.min("doc").alias("class_id"))
    nodes = nodes.join(classes, "root").select("node", F.col("digest").alias("of"), "root", "class_id", "links", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"))
    out = drawn.select("doc_id", "key", "row", "digest").join(nodes, F.col("digest") == F.col("of"), "left")
    return out.select("row", "key", "node", "root", "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"))


def keep_one_of_each_class(documents: DataFrame, **options) -> DataFrame:
    """Exactly one row of each class, all columns: of the least doc_id (null only where the class has
    no other), then the least hash of the text.  A row without words is a class of its own and stays.

    Rows that repeat an id, or have none, are told apart by a number of the row.
    """
    spark = documents.sparkSession
    path = shared_dir(spark)
    columns = documents.columns
    own, first_row = unused(documents, "__row"), unused(documents, "__first")
    numbered = materialize(documents.withColumn(own, F.monotonically_increasing_id()), f"{path}/rows")
    classes = _classes(numbered.select(F.col(own).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), **options)
    first = classes.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "row"))["row"].alias(first_row))
    stay = first.select(first_row).unionByName(classes.where("root is null").select(F.col("row").alias(first_row)))
    return numbered.join(stay, F.col(own) == F.col(first_row), "left_semi").select(*[F.col(f"`{c}`") for c in columns])
