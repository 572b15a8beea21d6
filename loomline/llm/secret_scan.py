"""Secret scans (operator 10): sliding-window entropy over candidate strings.

Base patterns give assignments, access keys and hexadecimal runs.  The method adds ``entropy``
spans: for each candidate string of at least ``window`` key characters a window slides over it, with
the Shannon entropy of its characters kept up to date from counts (one character leaves, one
enters).  Each character class (hexadecimal, letters and digits, base64) has its own threshold, which holds for
the whole candidate and for each run of a narrower class in it.
Allow-listed candidates are left alone: words without digits, repeated characters, ids with dashes
of a known form, numbers, paths.

Offsets are code points, ends exclusive.  Defined results: a null text is empty and has no span;
rows that repeat a ``doc_id`` are scanned each on its own; extra columns are ignored; cost is linear
in the text's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only

# Fixed patterns of the base
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RUNS = (re.compile(r"[A-Za-z0-9]{20,}"), re.compile(r"[0-9A-Fa-f]{20,}"))
ALLOWED = (
    re.compile(r"[A-Za-z_/=+-]*"),  # no digit
    re.compile(r"[0-9_/=+-]*"),  # no letter
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"[a-z0-9]+([-_/][a-z0-9]{1,15}){2,}"),  # slugs and paths of short parts
)


@dataclass(frozen=True)
class EntropyRule:
    """The least entropy in bits over ``window`` characters for each character class."""

    window: int = 20
    hexadecimal: float = 3.0
    alphanumeric: float = 3.7
    base64: float = 3.9


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hexadecimal"
    return "alphanumeric" if s.isalnum() else "base64"


def entropy_runs(s: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal runs of ``s`` covered by windows whose entropy reaches ``least``."""
    counts: dict[str, int] = {}
    log = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    total, base = 0.0, math.log2(window)  # entropy = log2(window) - sum(c log2 c) / window
    begin = end = -1
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += log[k + 1] - log[k]
        if i >= window:
            old = s[i - window]
            k = counts[old]
            counts[old] = k - 1
            total += log[k - 1] - log[k]
        if i >= window - 1 and base - total / window >= least - 1e-9:
            start = i - window + 1
            if start > end:
                if begin >= 0:
                    yield begin, end
                begin = start
            end = i + 1
    if begin >= 0:
        yield begin, end


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOWED)


def candidate_runs(s: str, rule: EntropyRule) -> list[tuple[int, int]]:
    """Runs of a candidate by the class of the whole, and of each run of letters and digits and of
    hexadecimal characters in it by its own: a key after ``sig=`` is judged as the key alone."""
    parts = {(0, len(s))} | {m.span() for p in RUNS for m in p.finditer(s)}
    found = []
    for a, b in parts:
        part = s[a:b]
        if not allowed(part):
            found += [(a + x, a + y) for x, y in entropy_runs(part, rule.window, getattr(rule, character_class(part)))]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_spans(text: str, rule: EntropyRule = EntropyRule()) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        out += [("hex", m.start() + h.start(), m.start() + h.end()) for h in HEX.finditer(s)]
        out += [("entropy", m.start() + a, m.start() + b) for a, b in candidate_runs(s, rule)]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def scan(documents: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) for each row of ``documents``."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def find(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(t, rule)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    rows = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def span_digest(scanned: DataFrame) -> DataFrame:
    def said(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(text: str, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in find_spans(text, rule):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_documents(documents: DataFrame, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``documents``, secrets in ``text`` replaced; null stays null."""

    def mask(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([t and redact(t, rule, mark) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", new)

    return documents.mapInArrow(mask, documents.schema)
