"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bucket(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(docs, width=4, num=85, den=100):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    links = []
    for x, i in enumerate(order):
        for y in range(x + 1, len(order)):
            a, b = sets[i], sets[order[y]]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num and den * len(a & b) >= num * len(a | b):
                links.append((x, y))
    part = components(len(order), links)
    return {docs[i][0]: (len(sets[i]), docs[order[part[x]]][0]) for x, i in enumerate(order)}


def embedding(rows, threshold=0.95):
    import numpy as np

    good = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    good.sort(key=lambda i: rows[i][0])
    unit = [np.asarray(rows[i][1], np.float64) for i in good]
    unit = [v / np.sqrt((v * v).sum()) for v in unit]
    links = [(a, b) for a in range(len(good)) for b in range(a + 1, len(good)) if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]
    part = components(len(good), links)
    count = Counter(x for pair in links for x in pair)
    out = {rows[i][0]: (0, rows[i][0]) for i in range(len(rows))}
    return out | {rows[i][0]: (count[x], rows[good[part[x]]][0]) for x, i in enumerate(good)}


def lm_base(docs):
    streams = {k: [*words(t), None] for k, t in docs}
    train = Counter(w for k, s in streams.items() if bucket(k, 7) != 2 for w in s)
    n, v = sum(train.values()), len(train)
    return {k: (bucket(k, 7) == 2, len(s), sum(train[w] > 0 for w in s), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in s)) for k, s in streams.items()}


def lm_model(docs, train, weight=0.6, order=3):
    """Probability of a gram's last token (a tuple; None is the end) under the interpolated model, with no filter: each count is the mean of those of its order and level."""
    taught = [[None] * (order - 1) + [*words(t), None] for k, t in docs if train(k)]
    counts = {n: Counter(tuple(s[i - n + 1 : i + 1]) for s in taught for i in range(order - 1, len(s))) for n in range(1, order + 1)}
    ones, twos = ({n: sum(v == c for v in counts[n].values()) for n in counts} for c in (1, 2))
    total, distinct = sum(counts[1].values()), len(counts[1])
    alike = {n: [[c for g, c in counts[n].items() if c.bit_length() == level and (n > 1 or g != (None,))] for level in range(50)] for n in counts}
    mean = {n: [sum(x) / len(x) if x else 0.0 for x in alike[n]] for n in counts}
    level = lambda g: mean[len(g)][counts[len(g)][g].bit_length()]
    held = lambda g: float(len(taught)) if set(g) == {None} else level(g)

    def p(g):
        out = min(1.0, (held(g[-1:]) + 1) / (total + distinct + 1))
        for n in range(2, order + 1):
            seen = level(g[-n:])
            context = max(held(g[-n:-1]), seen)
            if context:
                less = ones[n] / (ones[n] + 2 * twos[n]) if ones[n] else 0.0
                own = weight * max(context - less, 0.0) / context
                out = own * seen / context + (1 - own) * out
        return out

    return p


def lm_score(docs, train, weight=0.6, order=3):
    """log10 probabilities of texts under ``lm_model``."""
    p = lm_model(docs, train, weight, order)
    streams = {k: [None] * (order - 1) + [*words(t), None] for k, t in docs}
    return {k: sum(math.log10(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))) for k, s in streams.items()}


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    counts = Counter(k for k, _, _ in found)
    order = {"assign": 0, "access": 1, "hex": 2}
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], order[s[0]])))
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest()


def top_k(rows, queries, k=5, scale=256):
    usable = {i: [math.floor(scale * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q not in usable:
            continue
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
