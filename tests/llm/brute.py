"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substrings(rows, k=13):
    first, each = {}, {i: words(t) for i, t in rows}
    for i in sorted(each):
        for p in range(len(each[i]) - k + 1):
            first.setdefault(tuple(each[i][p : p + k]), i)
    out = {}
    for i, w in each.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffixes(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            x = b[s : s + width]
            if x in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(x)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n=3):
    w = words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def jaccard(rows, num=90, den=100):
    sets = {i: shingles(t) for i, t in rows}
    groups, posts = Groups(sets), defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in posts[g])
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                groups.join(i, j)
        for g in s:
            posts[g].append(i)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def quality(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licences(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
