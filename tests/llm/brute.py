"""Plain, slow versions of the contracts, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring_dedup(docs, k=20):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = SPACE.findall(text or "")
        gone = set()
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            if t in seen:
                gone.update(range(i, i + k))
            seen.add(t)
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


_BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def secrets(text):
    found = []
    for k, (kind, form, good) in enumerate(_BASE):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in form.finditer(text or "") if good(m)]
    kinds = Counter(k for _, k, _ in found)
    return kinds[0], kinds[1], kinds[2], sha(",".join(x for *_, x in sorted(found)))


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licenses(text):
    w = ALNUM.findall((text or "").translate(UP))
    at, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def shingles(text, k=5):
    w = SPACE.findall((text or "").translate(UP))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def quality(text):
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    runs = defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def contamination(docs, items, k=13):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UP))
        for i in range(max(1, len(w) - k + 1)):
            if w:
                windows[tuple(w[i : i + k])].add(str(item))
    sizes, out = {len(t) for t in windows}, {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(UP))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[t]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def suffix_dedup(docs, k=400):
    count = Counter()
    raw = {d: (t or "").encode() for d, t in docs}
    for b in raw.values():
        count.update(b[i : i + k] for i in range(len(b) - k + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = b"\x01" * k
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out
