"""Personal data (operator 11): labelers vote on candidate spans, expectation-maximisation weighs them.

Base patterns give e-mail and IP addresses, payment cards and international telephone numbers; these
spans always stay.  Further candidates are written-out addresses (``ann at example dot org``), other digit
groups and capitalised names; what failed a test of the base is none.  Five labelers vote yes, no or nothing on every candidate, base spans
included: pattern, gazetteer, context, shape and neighbourhood.  All votes of the corpus are
counted by kind and pattern of votes (at most 7 x 243 numbers), from which expectation-maximisation
estimates how often each labeler says what about a true and a false span, and the share of true ones
of each kind.  Base spans are known to be true; a labeler's yes never speaks against a span, nor its no
for one.  The resulting probabilities are the targets of a logistic regression on features of the
span and its surroundings, fitted on all candidates, counted by their features (at most
``N_FEATURES`` numbers).  A candidate that this classifier gives ``ACCEPT`` or more is a span of the method.

Texts are read once: candidates are written, a few bytes for each text, and counted and judged from there.

Offsets are code points, ends exclusive.  Defined results: a null text is empty and has no span; rows
that repeat a ``doc_id`` are scanned each on its own; extra columns are ignored; an empty table gives no
rows; cost is linear in the text's length: patterns don't start twice in one run of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, only, shared_dir, tidy

KINDS = ("email", "ip", "card", "phone", "contact", "number", "person")
BASE = 4
LABELERS = ("pattern", "gazetteer", "context", "shape", "neighbour")
ACCEPT = 0.8
#: votes that the first guess of a labeler's reliability weighs, as a share of all
PRIOR_SHARE = 0.02
#: the share of true spans of a further kind that is guessed first, which weighs as much
FIRST_SHARE = 0.2
#: characters before a span in which context is sought, and around it in which a base span is a neighbour
BEFORE, NEAR = 48, 200

# Fixed patterns of the base.  They find what the plain ones find: a domain is looked for at each @ and the
# local part before it; an address starts with its whole first number; a card is 16 digits or more.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Further candidates
_WRITTEN = re.compile(r"(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,63})+")
_DIGITS = re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+"
_PERSON = re.compile(rf"\b{_CAPITAL}(?: {_CAPITAL}){{1,2}}+")

# Fixed word lists of the labelers
_ENDINGS = frozenset("com org net edu gov info de fr es uk eu io co us at ch it nl be".split())
_CODES = ("1", "7", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
_NAMES = frozenset("Anna Maria Peter Paul John Mary James Robert Michael William David Thomas Sarah Laura Emma Julia Lena Hans Karl Klaus Sabine Petra Jean Pierre Marie Claire Sophie Luc Juan Carlos Jose Carmen Lucia Pablo Elena Otto Eva Jane Alice George Henry Daniel Martin Andrea Nina".split())
_TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Señor", "Señora")
_NO_NAMES = frozenset("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday License Licensed Apache Version Copyright General Public Software The This That New United Street".split())
_CUES = {
    "email": ("mail", "contact", "write", "@", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "address", "server", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "handy", "ring"),
    "contact": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "number": ("phone", "call", "tel", "mobile", "fax", "ssn", "social security", "passport", "account", "telefon", "iban", "konto"),
    "person": ("name is", "named", "contact", "regards", "signed", "author", "heiße", "heisse", "appelle", "llamo", "dear"),
}
_AGAINST = ("version", "isbn", "page", "figure", "fig.", "order", "invoice", "total", "price", "build", "release", "serial", "licen", "section")
# End of the word lists

_SIZES = (8, 12, 17)  # characters, upper bounds of the size classes
_RADIX = (len(KINDS), 3, 3, 3, 2, 3, 3, len(_SIZES) + 1)
N_FEATURES = int(np.prod(_RADIX))
N_VOTES = 3 ** len(LABELERS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            last = m.end()
            yield a, last


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, stop) of the base by kind, then start; and the matches that a test failed."""
    out, failed = [], []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            said = m[0]
            if kind == 1:
                good = all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in said.split(".")))
            else:
                n = len(re.sub("[^0-9]", "", said))
                good = 16 <= n <= 19 and luhn(re.sub("[ -]", "", said)) if kind == 2 else 8 <= n <= 15
            if good:
                out.append((kind, *m.span()))
            else:
                failed.append(m.span())
    return out, failed


def _further(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, stop) of candidates that meet nothing that is taken."""
    edges = sorted(taken)
    starts = np.array([a for a, _ in edges], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in edges], np.int64)) if edges else starts

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b)) - 1
        return k < 0 or int(ends[k]) <= a

    if " at " in text or "(at)" in text or "[at]" in text:
        for m in _WRITTEN.finditer(text):
            a = m.start()
            if a and text[a - 1] == " ":
                a -= 1
            b = a
            while a > max(0, b - 64) and text[a - 1] in _LOCAL:
                a -= 1
            if a < b and free(a, m.end()):
                yield 4, a, m.end()
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        n = sum(c.isdigit() for c in m[0]) if b - a < 60 else 60
        if n <= 19 and (b == len(text) or not (text[b].isalnum() or text[b] == "_")) and free(a, b):
            yield 5, a, b
    for m in _PERSON.finditer(text):
        if free(*m.span()):
            yield 6, *m.span()


def votes_on(text: str, kind: int, a: int, b: int, near: bool) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler."""
    said, before = text[a:b], text[max(0, a - BEFORE) : a]
    low, name = before.lower(), KINDS[kind]
    digits = "".join(c for c in said if c in "0123456789")
    pattern = gazetteer = shape = 0
    if kind < BASE:
        pattern = 1
    if kind in (0, 4):
        ending = re.split(r"[^A-Za-z0-9]+", said)[-1].lower()
        gazetteer = 1 if ending in _ENDINGS else -1 if kind == 4 else 0
        shape = 1 if kind == 0 or len(said) >= 10 else 0
        if kind == 4:
            pattern = 1 if "(" in said or "[" in said else 0
    elif kind == 1:
        gazetteer = -1 if said.startswith(("10.", "127.", "192.168.", "0.")) else 0
    elif kind == 6:
        words = said.split(" ")
        pattern = 1 if before.rstrip().endswith(_TITLES) else 0
        gazetteer = -1 if not _NO_NAMES.isdisjoint(words) else 1 if words[0] in _NAMES else 0
        shape = -1 if len(set(words)) < len(words) or max(map(len, words)) > 15 else 0
    else:
        groups = tuple(len(x) for x in re.findall("[0-9]+", said))
        if kind == 2:
            gazetteer = 1 if said[0] in "3456" else -1
        elif kind == 3:
            gazetteer = 1 if digits.startswith(_CODES) else 0
        elif re.fullmatch(r"(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}", said):
            pattern = -1
        elif groups in ((3, 3, 4), (3, 2, 4), (2, 2, 2, 2, 2), (3, 4, 4), (3, 7), (4, 7)):
            pattern = 1
        shape = -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" or digits in "98765432109876543210" else 1 if len(groups) > 1 else 0
    context = 1 if any(c in low for c in _CUES[name]) else 0
    if any(c in low for c in _AGAINST):
        context -= 1
    return pattern, gazetteer, context, shape, int(near)


def _side(c: str) -> int:
    return 0 if c == "" or c.isspace() else 2 if c.isalnum() else 1


def features_of(text: str, kind: int, a: int, b: int, votes: tuple[int, ...]) -> int:
    """The features as one number: kind, votes of gazetteer, context, shape and neighbourhood, what
    stands on each side, and a class of size.  The pattern's own vote is none of them."""
    size = sum(b - a > s for s in _SIZES)
    digits = (kind, votes[1] + 1, votes[2] + 1, votes[3] + 1, votes[4], _side(text[a - 1 : a]), _side(text[b : b + 1]), size)
    out = 0
    for d, r in zip(digits, _RADIX, strict=True):
        out = out * r + d
    return out


def candidates_of(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, stop, votes, features) by kind, then start; votes as a number of base three."""
    base, failed = base_spans(text)
    found = base + list(_further(text, [(a, b) for _, a, b in base] + failed))
    if not found:
        return []
    found.sort()
    place = np.sort(np.array([a for _, a, _ in base], np.int64))
    out = []
    for kind, a, b in found:
        near = int(np.searchsorted(place, b + NEAR, "right") - np.searchsorted(place, a - NEAR)) - (kind < BASE) > 0
        votes = votes_on(text, kind, a, b, near)
        number = 0
        for v in votes:
            number = 3 * number + v + 1
        out.append((kind, a, b, number, features_of(text, kind, a, b, votes)))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.int32()), ("features", pa.int32())])


def find_candidates(documents: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop, votes, features), for each row."""

    def find(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "stop", "votes", "features"), c, strict=True)) for c in candidates_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(find), "doc_id long, spans array<struct<kind:int,start:long,stop:long,votes:int,features:int>>")


class Reliabilities:
    """What labelers say about true and false spans, and the share of true ones of each kind."""

    def __init__(self, kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 200):
        say = votes[:, None] // 3 ** np.arange(len(LABELERS))[::-1] % 3  # 0 no, 1 nothing, 2 yes
        count = count.astype(float)
        guess = np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])  # of a false and a true span: no, nothing, yes
        self.says = np.repeat(guess[None], len(LABELERS), 0)
        base = np.arange(len(KINDS)) < BASE
        self.share = np.where(base, 1 - 1e-9, FIRST_SHARE)
        weight = PRIOR_SHARE * max(count.sum(), 1.0)
        for _ in range(rounds):
            p = np.where(base[kind], 1.0, self.posterior(kind, say))
            says = weight * np.repeat(guess[None], len(LABELERS), 0)
            for y, w in ((0, (1 - p) * count), (1, p * count)):
                for j in range(len(LABELERS)):
                    says[j, y] += np.bincount(say[:, j], w, 3)
            total = np.bincount(kind, count, len(KINDS))
            few = 1 + PRIOR_SHARE * total
            share = np.where(base, 1 - 1e-9, (np.bincount(kind, p * count, len(KINDS)) + FIRST_SHARE * few) / (total + few))
            says /= says.sum(2, keepdims=True)
            for word, more in ((0, 0), (2, 1)):  # no is said of false ones at least as often, yes of true ones
                wrong = says[:, more, word] < says[:, 1 - more, word]
                says[wrong, :, word] = says[wrong, :, word].mean(1, keepdims=True)
            says[:, :, 1] = 1 - says[:, :, 0] - says[:, :, 2]
            moved = max(np.abs(says - self.says).max(), np.abs(share - self.share).max())
            self.says, self.share = says, share
            if moved < 1e-9:
                break
        self.table = self.posterior(np.repeat(np.arange(len(KINDS)), N_VOTES), np.tile(np.arange(N_VOTES), len(KINDS))[:, None] // 3 ** np.arange(len(LABELERS))[::-1] % 3).reshape(len(KINDS), N_VOTES)

    def posterior(self, kind: np.ndarray, say: np.ndarray) -> np.ndarray:
        true, false = np.log(self.share[kind]), np.log1p(-self.share[kind])
        for j in range(len(LABELERS)):
            true = true + np.log(self.says[j, 1, say[:, j]])
            false = false + np.log(self.says[j, 0, say[:, j]])
        return 1 / (1 + np.exp(np.clip(false - true, -500, 500)))


def _one_hot(features: np.ndarray) -> np.ndarray:
    parts, left = [], features.astype(np.int64)
    for r in reversed(_RADIX):
        parts.append(np.eye(r)[left % r])
        left = left // r
    return np.concatenate([np.ones((len(features), 1)), *parts], 1)


def fit_classifier(features: np.ndarray, count: np.ndarray, positive: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression of soft targets, by Newton's method on counted features."""
    x, w = _one_hot(features), np.zeros(1 + sum(_RADIX))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (positive - count * p) - ridge * w
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scan(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop) by kind, then start, for each row."""
    found = materialize(find_candidates(documents), f"{shared_dir(documents.sparkSession)}/candidates")
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    counted = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("k")).toArrow()
    model = Reliabilities(*(counted.column(c).to_numpy() for c in ("kind", "votes", "k")))
    posterior = F.element_at(F.array(*map(F.lit, model.table.ravel().tolist())), F.col("kind") * N_VOTES + F.col("votes") + 1)
    soft = each.groupBy("features").agg(F.count(F.lit(1)).alias("k"), F.sum(posterior).alias("p")).toArrow()
    w = fit_classifier(*(soft.column(c).to_numpy() for c in ("features", "k", "p")))
    good = 1 / (1 + np.exp(-np.clip(_one_hot(np.arange(N_FEATURES)) @ w, -30, 30))) >= accept

    def judge(batches):
        names = pa.array(KINDS)
        for batch in batches:
            spans = batch.column("spans")
            cells = spans.flatten()
            kind, start, stop, _, features = cells.flatten()
            row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
            stay = np.flatnonzero((kind.to_numpy() < BASE) | good[features.to_numpy()])
            took = pa.array(stay)
            kept = pa.StructArray.from_arrays([names.take(kind.take(took)), start.take(took), stop.take(took)], ["kind", "start", "stop"])
            edges = np.searchsorted(row[stay], np.arange(len(spans) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), kept)], names=["doc_id", "spans"])

    return found.mapInArrow(judge, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def span_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base and all spans as text."""

    def said(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return scanned.select("doc_id", *map(n, KINDS[:BASE]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
