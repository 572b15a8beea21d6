"""Operator 11 against the plain patterns, and its model on votes and texts with known truth."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomline.llm import personal_data as pd_

from . import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        odd, even = d[-1::-2], d[-2::-2]
        if 16 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_is_what_the_plain_patterns_find():
    rng = random.Random(3)
    pieces = ["4242424242424242", "1.2.3.4", "256.1.1.1", "001.2.3.0004", "+1 (743) 555-3824", "+1((", "a@b.c", "x.y@z", "@b.c@d.e", "..", "-", " ", "7", "55 66-77", "é", "x@y..z", "_", "+", ")9", "\n", "1 2 3"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        got = [(pd_.KINDS[k], a, b) for k, a, b in pd_.base_spans(text)[0]]
        assert got == plain(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "1.", "a.", "+1(", "Aa ", " at ", "1-", "@a.", "é", "Aa"])
def test_long_runs_take_linear_time(unit):
    assert len(pd_.candidates_of(unit * (400_000 // len(unit)))) >= 0


def test_query_on_awkward_rows(spark):
    texts = [r[1] for r in cases.documents()] + ["mail a@b.org or +49 30 1234567", "host 10.0.0.1 card 4111 1111 1111 1111"]
    df = spark.createDataFrame([(k if k != 3 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    got = pd_.span_digest(pd_.scan(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        want = plain(text)
        assert [r[f"n_{k}"] for k in pd_.KINDS[:4]] == [sum(w[0] == k for w in want) for k in pd_.KINDS[:4]]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) <= set(r.spans.split(","))
    assert pd_.scan(df.limit(0)).count() == 0


def test_reliabilities_are_found_from_votes_alone():
    rng = np.random.default_rng(1)
    right = [0.95, 0.8, 0.7, 0.6, 0.65]  # share of right votes among those given
    truth = rng.random(60_000) < 0.3
    votes = np.zeros(len(truth), int)
    for r in right:
        says = np.where(rng.random(len(truth)) < r, truth, ~truth) * 2
        votes = votes * 3 + np.where(rng.random(len(truth)) < 0.7, says, 1)
    kind = np.full(len(truth), 5)
    pattern, count = np.unique(votes, return_counts=True)
    model = pd_.Reliabilities(np.full(len(pattern), 5), pattern, count)
    found = model.table[kind, votes] > 0.5
    say = votes[:, None] // 3 ** np.arange(5)[::-1] % 3 - 1
    known = say @ np.log(np.array(right) / (1 - np.array(right))) + np.log(0.3 / 0.7) > 0  # with the true reliabilities
    majority = say.sum(1) > 0
    assert (found == truth).mean() > max((known == truth).mean() - 0.01, (majority == truth).mean() + 0.03)
    assert abs(model.share[5] - 0.3) < 0.05
    given = model.says[:, 1, 2] / (model.says[:, 1, 0] + model.says[:, 1, 2])
    assert np.abs(given - right).max() < 0.08


def made_texts(n, seed):
    """Texts with the spans that are personal data, and spans that only look like it."""
    rng = random.Random(seed)
    filler = "the river runs under stone walls where quiet light falls on green paper in early winter".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        words = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(25, 60)))
        name = rng.choice(["Anna", "Otto", "Maria", "Pablo"]) + " " + rng.choice(["Berg", "Stone", "Garcia", "Weber"])
        kind = rng.randrange(8)
        said, good = [
            (f"call me on {digits(3)}-{digits(3)}-{digits(4)}", True),
            (f"phone ({digits(3)}) {digits(3)}-{digits(4)}", True),
            (f"write to ann{digits(2)} at mail dot com", True),
            (f"my name is {name}", True),
            (f"version {digits(4)}.{digits(2)}.{digits(3)}", False),
            (f"order total {digits(9)}", False),
            (f"on page {digits(8)}", False),
            ("in the New Version", False),
        ][kind]
        start = {0: 11, 1: 6, 2: 9, 3: 11}.get(kind, 0)
        head = words() + " "
        text = head + said + " " + words() + (f" a{digits(2)}@mail.example.com" if rng.random() < 0.3 else "")
        out.append((text, (len(head) + start, len(head) + len(said)) if good else None))
    return out


def test_held_out_precision_and_recall(spark):
    made = made_texts(1500, 1)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string").repartition(4)
    hit = missed = wrong = 0
    for r in pd_.scan(df).collect():
        added = [(s.start, s.stop) for s in r.spans if s.kind not in pd_.KINDS[:4]]
        want = made[r.doc_id][1]
        found = [s for s in added if want and s[0] < want[1] and want[0] < s[1]]
        hit += bool(found)
        missed += want is not None and not found
        wrong += len(added) - len(found)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9, (hit, missed, wrong)
