"""Plain versions of the operators, straight from their definitions."""

import hashlib
import itertools
import math
import string
from collections import Counter


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(t):
    return (t or "").encode().split()


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_classes(rows, threshold=(4, 5)):
    """(doc_id, class_id, n_links, n_text_links) of rows that all have a doc_id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, texts = [0] * len(rows), [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and common * threshold[1] >= threshold[0] * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            if sets[i] != sets[j]:
                texts[i].add(frozenset(sets[j]))
                texts[j].add(frozenset(sets[i]))
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least[find(i)], links[i], len(texts[i])) for i, (d, _) in enumerate(rows)]


def substring_dedup(rows, window=35):
    ws = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in ws for p in range(len(w) - window + 1))
    out = []
    for d, w in ws:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def suffix_dedup(rows, width=100):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen, done = set(), {}
    for d, b in sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1]).digest())):
        gone = set()
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone.update(range(p, p + width))
            seen.add(s)
        runs = sum(1 for i in gone if i - 1 not in gone)
        done[d, b] = (d, len(b), len(gone), runs, sha(bytes(x for i, x in enumerate(b) if i not in gone)))
    return [done[x] for x in texts]


# Fixed word list: the commonest function words of English, German, French and Spanish
STOP_WORDS = """
the of and to in that is for it with as on be at by this are or from
der die das und in zu den mit von ist nicht auf für ein eine im dem
de la le les et des en un une du que dans pour qui sur au par
el los las y del se por con una para es al lo como
"""


def quality(rows):
    import re

    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
        stops = len(set(STOP_WORDS.split()) & set(w))
        kept = not failed and 2 <= chars / len(w) <= 16 and symbols / chars <= 0.2 and stops >= 2 and (len(ls) - len(set(ls))) / len(ls) <= 0.5
        out.append((d, len(w), chars, symbols, len(ls) - len(set(ls)), len(rep), failed, kept))
    return out


def license_tokens(text):
    """(token, start, stop) of runs of letters, digits and anything beyond ASCII."""
    out, at = [], None
    for i, c in enumerate((text or "") + " "):
        if c in string.ascii_letters + string.digits or ord(c) > 127:
            at = i if at is None else at
        elif at is not None:
            word = text[at:i]
            out.append(("".join(x.lower() if ord(x) < 128 else x for x in word), at, i))
            at = None
    return out


def licenses(rows, templates, containment=(4, 5)):
    """Every match by the definition, looking at every place of every text for every template."""

    def parts(tokens):
        w = [t for t, _, _ in tokens]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)

    out = []
    for d, text in rows:
        tokens = license_tokens(text)
        have = parts(tokens)
        for k, (name, template) in enumerate(templates):
            own = parts(license_tokens(template))
            wanted, reach = set(own), -(-len(own) * containment[1] // containment[0])
            i = 0
            while i < len(have):
                if have[i] in wanted:
                    window = have[i : i + reach]
                    held = set(window) & wanted
                    if len(held) * containment[1] >= containment[0] * len(wanted):
                        last = i + max(window.index(x) for x in held)
                        out.append((d, name, k, tokens[i][1], tokens[min(last + 5, len(tokens)) - 1][2], len(held) / len(wanted)))
                        i = last
                i += 1
    return out


KEY_CHARACTERS = set(string.ascii_letters + string.digits + "+/_=-")
ORDER = ("assign", "access", "hex", "entropy")


def _stretch(text, i, allowed):
    j = i
    while j < len(text) and text[j] in allowed:
        j += 1
    return j


def base_secrets(text):
    """The base spans by reading characters, without any pattern."""
    out, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(word)].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) != word:
                continue
            j = i + len(word)
            for j in [j + 1, j] if text[j : j + 1] in ("'", '"') and text[j : j + 1] else [j]:
                j = _stretch(text, j, " ")
                if text[j : j + 1] not in (":", "=") or not text[j : j + 1]:
                    continue
                j = _stretch(text, j + 1, " ")
                if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
                    j += 1
                stop = _stretch(text, j, set(string.ascii_letters + string.digits + "+/_.=-"))
                if stop > j:
                    end = stop, stop - j
                    break
            if end:
                break
        if end:
            if end[1] >= 6:
                out.append(("assign", i, end[0]))
            i = end[0]
        else:
            i += 1
    i = 0
    while i < len(text):
        j = _stretch(text, i + 4, set(string.ascii_uppercase + string.digits)) if text.startswith("AKIA", i) else i
        if j > i + 4:
            if j - i >= 20:
                out.append(("access", i, j))
            i = j
        else:
            i += 1
    i = 0
    while i < len(text):
        j = _stretch(text, i, set("0123456789abcdef"))
        if j - i >= 24:
            out.append(("hex", i, j))
        i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[1], ORDER.index(x[0])))


def entropy_secrets(text, least=(3.0, 3.7, 3.9), window=20):
    """Entropy spans: every window of every part of every candidate, its entropy from scratch."""
    hexadecimal, alphanumeric = set(string.hexdigits), set(string.ascii_letters + string.digits)

    def pieces(s, base, allowed):
        i = 0
        while i < len(s):
            j = _stretch(s, i, allowed)
            if j - i >= window:
                yield s[i:j], base + i
            i = max(j, i + 1)

    def ignored(s):
        if not set(s) & set(string.digits) or not set(s) & set(string.ascii_letters):
            return set(s) <= KEY_CHARACTERS
        groups = s.split("-")
        if [len(g) for g in groups] == [8, 4, 4, 4, 12] and all(set(g) <= hexadecimal for g in groups):
            return True
        if set(s) <= set(string.ascii_lowercase + string.digits + "-_/"):
            for c in "-_/":
                s = s.replace(c, " ")
            parts = s.split(" ")
            return len(parts) >= 3 and all(parts) and all(len(p) <= 15 for p in parts[1:])
        return False

    out = []
    for candidate, at in pieces(text, 0, KEY_CHARACTERS):
        covered = set()
        for s, i in {(candidate, at), *pieces(candidate, at, alphanumeric), *pieces(candidate, at, hexadecimal)}:
            if ignored(s):
                continue
            bound = least[0] if set(s) <= hexadecimal else least[1] if set(s) <= alphanumeric else least[2]
            for k in range(len(s) - window + 1):
                counts = Counter(s[k : k + window]).values()
                if -sum(c / window * math.log2(c / window) for c in counts) >= bound - 1e-9:
                    covered.update(range(i + k, i + k + window))
        begin = None
        for x in range(at, at + len(candidate) + 1):
            if x in covered and begin is None:
                begin = x
            elif x not in covered and begin is not None:
                out.append(("entropy", begin, x))
                begin = None
    return out


def secrets(text):
    return sorted(base_secrets(text) + entropy_secrets(text), key=lambda x: (x[1], ORDER.index(x[0])))
