"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def near_duplicates(docs, k=5, percent=75):
    sets = []
    for _, t in docs:
        w = re.findall(SPACE, lower(t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        own = [x for x in ids[root(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(own, default=None)))
    return out


def removals(docs, span=35):
    words = [re.findall(SPACE, t or "") for _, t in docs]
    n = Counter(tuple(w[i:i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - span + 1) if n[tuple(w[i:i + span])] > 1 for j in range(i, i + span)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(docs, items, span=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    win = defaultdict(set)
    for i, t in items:
        w = cut(t)
        m = min(span, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            win[tuple(w[p:p + m])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for m in {len(x) for x in win}:
            for p in range(len(w) - m + 1):
                if tuple(w[p:p + m]) in win:
                    hit.update(range(p, p + m))
                    found |= win[tuple(w[p:p + m])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def _own_line_faults(lines):
    """Which of a text's lines with a word fail a rule that needs no other text, and their words."""
    marks = set(".!?:;\"')]»”’。！？")
    seps = set("|>/›·•→")
    notices = ["all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy",
               "cookie policy", "uses cookies", "use of cookies", "enable javascript", "skip to content",
               "subscribe to our newsletter", "back to top"]
    cut = [re.findall(SPACE, x) for x in lines]
    menu = [len(x) <= 6 and x[-1][-1] not in marks for x in cut]
    out = []
    for i, (line, x) in enumerate(zip(lines, cut)):
        signs, lone = len(re.findall(r"[#*$%&|<>]", line)), sum(y in seps for y in x)
        bad = line in lines[:i] or signs > 0.1 * max(sum(map(len, x)), 1) or x.count("|") >= 3
        bad = bad or len(x) >= 3 and sum("!!" in y for y in x) > 0.5 * len(x)
        bad = bad or len(x) <= 3 and x[-1][-1] not in marks or lone >= 3 and 4 * lone >= len(x)
        lo, hi = i, i
        while menu[i] and lo > 0 and menu[lo - 1]:
            lo -= 1
        while menu[i] and hi + 1 < len(lines) and menu[hi + 1]:
            hi += 1
        bad = bad or menu[i] and hi - lo + 1 >= 4
        out.append(bad or len(x) <= 24 and any(n in lower(line) for n in notices))
    return out, cut


def line_rules(docs):
    texts = [[x for x in (t or "").split("\n") if re.search(SPACE, x)] for _, t in docs]
    judged = [_own_line_faults(x) for x in texts]
    spread = defaultdict(set)
    for lines, (bad, cut) in zip(texts, judged):
        for i, x in enumerate(lines):
            if not bad[i] and len(cut[i]) <= 24:
                spread[x].add((lines[i - 1] if i else None, lines[i + 1] if i + 1 < len(lines) else None))
    least = max(10, math.ceil(sum(map(bool, texts)) / 1000))
    out = []
    for (d, t), lines, (own, cut) in zip(docs, texts, judged):
        t = t or ""
        w = re.findall(SPACE, t)
        n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        common = [not b and len(x) <= 24 and len(spread[y]) >= least for b, x, y in zip(own, cut, lines)]
        lost, more = (sum(len(y) for b, x in zip(f, cut) if b for y in x) for f in (own, common))
        chars = sum(map(len, w))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((d, len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), sum(own),
                    lost, sum(common), more, failed, not failed and lost <= 0.5 * chars and lost + more <= 0.9 * chars))
    return out


def ranking(docs, items, top=10):
    """Plain scores of the ranked search's contract."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    n_docs = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(cut(t))
    out = []
    for i, terms in wanted.items():
        got = []
        for d, c in held:
            n, score = sum(c.values()), 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                got.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(got, key=lambda x: x[:3])[:top])]
    return out


def planted(d, t):
    """The words of the periodic contract."""
    w = re.findall(SPACE, t or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def runs(w):
    """``(start, length, period)`` of all runs, by comparing every period at every place."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 4 * q:
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items() if n >= 6)


def periodic(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for d, t in docs:
        w = planted(d, t)
        r = runs(w)
        gone = {i for s, n, q in r for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in r), default=None)
        out.append((d, len(r), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
                    sha("".join(f"{s},{n},{q}\n" for s, n, q in r)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def vector_links(rows, cosine=0.95):
    """``(vec_id, n_links, component_id, kept)`` by all cosines."""
    width = max([len(v) for _, v in rows if v] + [1])
    unit = []
    for _, v in rows:
        ok = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.zeros(width)
        if ok:
            x[: len(v)] = np.array(v, float) / max(map(abs, v))
            x /= np.linalg.norm(x)
        unit.append(x)
    near = np.array(unit) @ np.array(unit).T >= cosine
    np.fill_diagonal(near, False)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        up[root(a)] = root(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        low = min([x for x in ids[root(i)] if x is not None], default=None)
        out.append((d, int(near[i].sum()), low, d == low))
    return out
