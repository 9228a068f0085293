"""Plain reference versions of the operators' contracts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, k=20):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for doc, text in order:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            window = tuple(w[i : i + k])
            if window in seen:
                gone[i : i + k] = [True] * k
            seen.add(window)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text):
    t = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    find = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(only(m)) <= 19 and luhn(only(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m)) <= 15],
    }
    text = ",".join(f"{k}:{a}:{b}" for k, spans in find.items() for a, b in spans)
    return [len(x) for x in find.values()], text


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])


def near_pairs(rows):
    """(a, b, weighted, plain) of all pairs of rows that share a shingle, or have no words."""
    sets = [shingles(t) for _, t in rows]
    df = collections.Counter(x for s in sets for x in s)
    idf = {x: 1 + math.log10(max((len(rows) + 1) / (n + 1), 1)) / 2 for x, n in df.items()}
    weights = [{x: (1 + math.log(n)) * idf[x] for x, n in s.items()} for s in sets]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders[x].append(i)
    done = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in sorted(done):
        v, w = weights[a], weights[b]
        if not v or not w:
            yield a, b, 1.0, 1.0
            continue
        least = sum(min(v[x], w[x]) for x in v.keys() & w.keys())
        yield a, b, least / (sum(v.values()) + sum(w.values()) - least), len(v.keys() & w.keys()) / len(v.keys() | w.keys())


def near_classes(rows, least=0.8):
    """Class (smallest doc_id) per row, by weighted similarity of all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, weighted, _ in near_pairs(rows):
        if weighted >= least:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return {d if d is not None else ("null", i): low.get(root(i)) for i, (d, _) in enumerate(rows)}


def lm_base(rows):
    low = lambda t: words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = collections.Counter()
    for d, t in rows:
        if not held[d]:
            c.update(low(t))
    n, v, out = sum(c.values()), len(c), {}
    for d, t in rows:
        w = low(t)
        out[d] = (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def top_k(rows, k=10):
    fine = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in fine:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def targets(sizes, most=3):
    """source -> target by resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def quality(text):
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover[i : i + 5] = [True] * 5
    failed = len(w) < 10 or 100 * sum(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(cover), failed


def languages(rows, suffixes):
    """(best language, posterior, has letters) of rows (text, declared, suffix, host, parent), one by one."""
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in b)
    cells = []
    for text, *_ in rows:
        t = fold((text or "").encode())
        codes = [t[i] << 16 | t[i + 1] << 8 | t[i + 2] for i in range(len(t) - 2)]
        cells.append([(c * 0x9E3779B97F4A7C15 % 2**64) >> 49 for c in codes if c != 0x202020])
    told = collections.Counter(r[1] for r in rows if r[1] is not None)
    names, size = sorted(told), 1 << 15
    grams = {x: collections.Counter(c for own, r in zip(cells, rows) if r[1] == x for c in own) for x in names}
    total = {x: sum(grams[x].values()) for x in names}
    host, parent = collections.Counter(), collections.Counter()
    for _, said, _, h, p in rows:
        if said is not None and h is not None:
            host[h, said] += 1
            parent[p, said] += 1
    hosts = {h: p for _, said, _, h, p in rows if said is not None and h is not None}
    out = []
    for own, (_, said, suffix, h, _) in zip(cells, rows):
        scale = min(len(own), 100) / max(len(own), 1)
        score = {}
        for x in names:
            s = scale * sum(math.log(0.9 * (grams[x][c] + 0.5) / (total[x] + 0.5 * size) + 0.1 / size) for c in own)
            for value, honest in ((said, 0.9), (suffixes.get(suffix), 0.7)):
                if value in told and len(names) > 1:
                    s += math.log(honest if value == x else (1 - honest) / (len(names) - 1))
            prior = (told[x] + 1) / (sum(told.values()) + len(names))
            p = hosts.get(h)
            for counts, key in ((parent, p), (host, h)):
                seen = sum(counts[key, y] for y in names) if p is not None or h in hosts else 0
                prior = ((counts[key, x] if h in hosts else 0) + 20 * prior) / (seen + 20)
            score[x] = s + math.log(prior)
        none = min(len(own), 100) * -math.log(size) + math.log(0.01) - sum(math.log(len(names)) for v in (said, suffixes.get(suffix)) if v in told)
        best = max(names, key=lambda x: (score[x], [-ord(c) for c in x]))
        whole = sum(math.exp(min(v - score[best], 700)) for v in [*score.values(), none])
        out.append((best, 1 / whole, bool(own)))
    return out


def robust_distances(vectors, floor, share=0.75, scale=1.487, settled=0.01):
    """Squared Mahalanobis distances by concentration steps from the medians."""
    x = np.array(vectors)

    def quantile(v, p):
        return np.sort(v)[max(math.ceil(p * len(v)) - 1, 0)]

    def inverse(cov):
        m = cov * scale
        m = m + np.diag(np.maximum(np.array(floor) ** 2 - np.diag(m), 0) + 1e-12)
        return np.linalg.inv(m), np.linalg.slogdet(m)[1]

    mean = np.array([quantile(v, 0.5) for v in x.T])
    inv, size = inverse(np.diag([((quantile(v, 0.75) - quantile(v, 0.25)) / 1.349) ** 2 for v in x.T]))
    for _ in range(15):
        off = x - mean
        d = np.einsum("ij,jk,ik->i", off, inv, off)
        near = x[d <= quantile(d, share)]
        mean = near.mean(axis=0)
        was, (inv, size) = size, inverse(np.cov(near.T, bias=True))
        if was - size <= settled:
            break
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, inv, off)
