"""The operators again, as plain loops over all rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contaminated(docs, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= {x for x in wins[k] if x is not None}
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return out


def without_repeats(docs, size=13):
    first = {}
    for doc, text in docs:
        w = blank_words(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if doc is not None:
                first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, text in docs:
        w, gone = blank_words(text), set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def without_repeated_bytes(docs, size=100):
    seen, out = set(), []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if (w := b[s : s + size]) in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(w)
        spans = sum(1 for x in range(len(b)) if gone[x] and not (x and gone[x - 1]))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def similar(docs, n=5, threshold=(8, 10)):
    sets = {}
    for doc, text in docs:
        w = plain_words(text)
        sets[doc] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    by_set = defaultdict(list)
    for doc, s in sets.items():
        by_set[s].append(doc)
    nodes = [s for s in by_set if s]
    parent, degree = list(range(len(nodes))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i):
            both = len(a & nodes[j])
            if both * threshold[1] >= threshold[0] * (len(a) + len(nodes[j]) - both):
                degree[i] += 1
                degree[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, s in enumerate(nodes):
        least[find(i)] = min([*by_set[s], *([least[find(i)]] if find(i) in least else [])])
    out = {doc: (doc, 0, 1) for doc in by_set.get(frozenset(), [])}
    for i, s in enumerate(nodes):
        for doc in by_set[s]:
            out[doc] = (least[find(i)], degree[i], len(by_set[s]))
    return out


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def kneser_ney(training, tests):
    """log10 probabilities of texts under interpolated modified Kneser-Ney trigrams."""
    end, start = "</s>", "<s>"
    tokens = lambda t: [*blank_words((t or "").translate(LOWER)), end]
    tri, uni = Counter(), Counter()
    for t in training:
        w = tokens(t)
        uni.update(w)
        for i in range(len(w)):
            tri[(w[i - 2] if i > 1 else start, w[i - 1] if i else start, w[i])] += 1
    bi = Counter()
    for (_, v, w), c in tri.items():
        bi[v, w] += c if v == start else 1
    one = Counter(w for _, w in bi)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]

    d1, d2, d3 = (discounts(list(c.values())) for c in (one, bi, tri))
    total1 = sum(one.values())
    floor = sum(d1[min(c, 3)] for c in one.values()) / total1 / (len(uni) + 1)
    sums = {2: defaultdict(lambda: [0, 0.0]), 3: defaultdict(lambda: [0, 0.0])}
    for order, counts, d in ((2, bi, d2), (3, tri, d3)):
        for k, c in counts.items():
            x = sums[order][k[:-1]]
            x[0] += c
            x[1] += c - d[min(c, 3)]

    def p(u, v, w):
        c = one.get(w, 0)
        out = (c - d1[min(c, 3)]) / total1 + floor
        for order, counts, d, ctx in ((2, bi, d2, (v,)), (3, tri, d3, (u, v))):
            if ctx in sums[order]:
                n, kept = sums[order][ctx]
                c = counts.get((*ctx, w), 0)
                out = (c - d[min(c, 3)]) / n + (1 - kept / n) * out
        return out

    scores = []
    for t in tests:
        w = tokens(t)
        scores.append(sum(math.log10(p(w[i - 2] if i > 1 else start, w[i - 1] if i else start, w[i])) for i in range(len(w))))
    return scores, sum(uni.values()), uni, p, [*uni, "unseen"]
