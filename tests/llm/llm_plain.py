"""Plain versions of what the operators must return, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import math

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def crc(value):
    return zlib.crc32(str(value).encode())


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def personal(text):
    """Base spans (start, kind, end) by the patterns alone."""
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p[-3:]) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def shingles(text, size):
    words = SPACE_WORD.findall(low(text))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_groups(texts, size=5, percent=80):
    """Root index of each text over all pairs."""
    sets = [shingles(t, size) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return roots(len(texts), links)


def contamination(texts, items, width=10):
    """Per text (words, hit words, sorted ids of items that occur)."""
    windows = defaultdict(set)
    for key, text in items:
        words = ALNUM_WORD.findall(low(text))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[i : i + width])].add(key)
    out = []
    for text in texts:
        words, hit, ids = ALNUM_WORD.findall(low(text)), set(), set()
        for i in range(len(words)):
            for n in {len(w) for w in windows}:
                if tuple(words[i : i + n]) in windows and i + n <= len(words):
                    hit.update(range(i, i + n))
                    ids |= {k for k in windows[tuple(words[i : i + n])] if k is not None}
        out.append((len(words), len(hit), sorted(map(str, ids))))
    return out


def unigrams(rows, taught):
    """Per text (tokens, known tokens, train tokens, base score)."""
    tokens = [SPACE_WORD.findall(low(t)) + [None] for t in rows]
    counts = Counter(w for t, yes in zip(tokens, taught) if yes for w in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t in tokens
    ]


def targets(sizes, weights, most=3.0):
    """Water filling, one source after the other."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if most * sizes[i] <= level * weights[i]}
        if not over:
            out |= {i: level * weights[i] for i in open_}
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return [out[i] for i in range(len(sizes))]
