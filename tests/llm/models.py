"""Plain Python versions of the operators, by other means than the operators' own."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORDS.findall(text or ""))


def mix(rows):
    """rows: [(doc_id, text, source)]; how often each is taken, by going through each source in the order of the digests."""
    own = defaultdict(list)
    for at, (k, text, source) in enumerate(rows):
        h = hashlib.md5(f"{'' if k is None else k}:{text or ''}".encode()).hexdigest()[:15]
        own[source].append((h, at, n_words(text)))
    sources = sorted(own, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for *_, n in own[s]) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    left, rest, target = set(sources), sum(size.values()), {}
    while left:
        share = rest / sum(weight[s] for s in left)
        above = {s for s in left if 3 * size[s] <= weight[s] * share}
        if not above:
            target |= {s: weight[s] * share for s in left}
            break
        target |= {s: 3.0 * size[s] for s in above}
        rest -= sum(3 * size[s] for s in above)
        left -= above
    times = [0] * len(rows)
    for s in sources:
        whole = min(3, int(target[s] // size[s])) if size[s] else 0
        budget, taken = target[s] - whole * size[s], set()
        order = sorted(own[s])
        for _ in range(3):
            used = 0
            short = [x for x in order if 0 < x[2] <= budget and x[1] not in taken]
            for _, at, n in short:
                if used + n > budget:
                    break
                used += n
                taken.add(at)
            budget -= used
        near = [(abs(n - budget), n, h, at) for h, at, n in order if n and at not in taken and abs(n - budget) < budget]
        if near:
            taken.add(min(near)[3])
        for _, at, _ in order:
            times[at] = whole + (at in taken)
    return times, [size[r[2]] for r in rows], [target[r[2]] for r in rows]


SYMBOLS = set("#*$%&|<>")
FLOORS = [0.25, 0.1, 0.25, 0.03, 0.05, 0.1]


def quality_vector(text):
    t = text or ""
    w = WORDS.findall(t)
    chars, n = sum(map(len, w)), len(w)
    grams = [tuple(w[i : i + 3]) for i in range(n - 2)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    capitals = sum(c.isupper() for c in t)
    rate = lambda k, of, least: math.log(k / (of + 1) + least)
    failed = n < 50 or 100 * len(hit) > 50 * n
    x = [
        *(rate(sum(c in SYMBOLS for c in t), chars, 0.003), rate(capitals, chars, 0.01), rate(t.count("!") + t.count("?"), chars, 0.003)),
        *(math.log((chars + 1) / (n + 1)), len(hit) / (n + 1), (len(lines) - len(set(lines))) / (len(lines) + 1)),
    ]
    return failed, x


def nth(x, q):
    """The least value that at least the share ``q`` of all isn't above."""
    s = np.sort(x)
    return s[max(math.ceil(q * len(s)), 1) - 1]


def determinant_estimate(x):
    """Centre and covariance (floors added) of the half with the least determinant that concentration steps come to."""
    floor = np.diag(np.square(FLOORS))
    centre = np.array([nth(c, 0.5) for c in x.T])
    spread = np.array([nth(np.abs(c - m), 0.5) for c, m in zip(x.T, centre, strict=True)])
    cov, det = np.diag((1.4826 * spread) ** 2) + floor, math.inf
    while True:
        d = distances(x, centre, cov)
        edge = nth(d, 0.5)
        inside = x[(d < edge) | (nth(d, 0.1) == edge)]
        new = inside.mean(axis=0), np.cov(inside.T, bias=True) + floor
        after = np.linalg.slogdet(new[1])[1]
        if not after < det - 0.01:
            return centre, cov
        (centre, cov), det = new, after


def distances(x, centre, cov):
    return np.einsum("ij,ij->i", x - centre, np.linalg.solve(cov, (x - centre).T).T)


def log_cut(u):
    def at(middle, deviation):
        return max(middle + 2.5 * deviation, math.log(22.4577) + max(0, middle - math.log(5.3481)))

    low, high = nth(u, 1 / 6), nth(u, 1 / 3)
    cut = at(high, (high - low) / 0.5367)
    for _ in range(10):
        inside = u[u <= cut]
        middle, upper = nth(inside, 0.5), nth(inside, 0.75)
        was, cut = cut, at(middle, (upper - middle) / 0.6745)
        if abs(cut - was) <= 0.01:
            break
    return cut


def quality(rows, least=200):
    """rows: [(text, lang, source)]; whether each is kept."""
    found = [quality_vector(t) for t, *_ in rows]
    usable = Counter((lang, source) for (_, lang, source), (failed, _) in zip(rows, found, strict=True) if not failed)
    by_lang = Counter()
    for (lang, _), n in usable.items():
        by_lang[lang] += n

    def group(lang, source):
        if usable[lang, source] >= least:
            return lang, source
        return (lang,) if by_lang[lang] >= least else ()

    members = defaultdict(list)
    for (_, lang, source), (failed, x) in zip(rows, found, strict=True):
        if not failed:
            for g in ((lang, source), (lang,), ()):
                members[g].append(x)
    cuts = {}
    for g in {group(lang, source) for _, lang, source in rows}:
        if members[g]:
            x = np.array(members[g])
            fit = determinant_estimate(x)
            cuts[g] = *fit, log_cut(np.log(distances(x, *fit) + 1e-3))
    out = []
    for (_, lang, source), (failed, x) in zip(rows, found, strict=True):
        fit = cuts.get(group(lang, source))
        out.append(not failed and (fit is None or bool(np.log(distances(np.array([x]), *fit[:2])[0] + 1e-3) <= fit[2])))
    return out


def languages(pages, names, stands_for, strength=5.0, trust=0.9, trust_pages=10.0):
    """pages: [(page_id, host, suffix, declared, evidence)]; the fused (lang, probability) of each."""
    posts = []
    for *_, e in pages:
        w = np.exp(e)
        posts.append(w / w.sum())
    n = len(names)
    sums, counts = defaultdict(lambda: np.zeros(n)), Counter()
    for (_, host, suffix, declared, _), p in zip(pages, posts, strict=True):
        for key in (("all",), ("host", host), ("suffix", suffix), *([("said", declared), ("any said",)] if declared is not None else [])):
            sums[key] += p
            counts[key] += 1
    above = (sums["all",] + 1) / (len(pages) + n)
    out = []
    for (_, host, suffix, declared, e), p in zip(pages, posts, strict=True):
        language = stands_for.get(suffix)
        hint = above if language not in names else np.array([trust if x == language else (1 - trust) * a for x, a in zip(names, above, strict=True)])
        by_suffix = (sums["suffix", suffix] + strength * hint) / (counts["suffix", suffix] + strength)
        own = sums["host", host] - p
        prior = (np.maximum(own, 0) + strength * by_suffix) / (counts["host", host] - 1 + strength)
        logs = np.array(e) + np.log(prior)
        if declared is not None:
            right = np.array([trust if x == declared else (1 - trust) / n for x in names])
            logs = logs + np.log((sums["said", declared] + trust_pages * right) / (sums["any said",] + trust_pages))
        w = np.exp(logs - logs.max())
        out.append((names[int(logs.argmax())], round(w.max() / w.sum(), 9)))
    return out
